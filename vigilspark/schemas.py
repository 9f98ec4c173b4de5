"""Schemas of the domain tables as DDL."""

from __future__ import annotations

CASE = "case_id long, case_number string, status string, severity string, category string, created_at timestamp, reviewed_at timestamp, loss double, officer_id long, notes string"
ENTITY = "case_id long, entity_type string, value string, seen_at timestamp, flag_count long"
OFFICER = "officer_id long, name string, badge string, district string, role string"
CRAWL_LOG = "source string, query string, items_found long, items_flagged long, status string, at timestamp"
FEEDBACK = "rec_id string, channel string, recommendation struct<action:string,urgency:string,strength:string>, decision string, outcome string, at timestamp"
POST = "message_id long, text string, timestamp timestamp, views long, forwards long, has_media boolean, media_type string, reactions_count long, reply_count long"
CHANNEL = (
    "channel_metadata struct<name:string,description:string,subscriber_count:long,creation_date:string,username:string,invite_link:string,is_verified:boolean>, "
    "posts array<struct<message_id:long,text:string,timestamp:string,views:long,forwards:long,has_media:boolean,media_type:string,reactions_count:long,reply_count:long>>, "
    "posting_schedule array<double>, posting_frequency double, language_distribution map<string,double>, media_ratio map<string,double>, forward_ratio double, "
    "growth_snapshots array<struct<date:string,subscribers:long>>, linked_channels array<string>, "
    "entities_found struct<phones:array<string>,upis:array<string>,urls:array<string>,qr_mentions:array<string>,telegram_links:array<string>>, "
    "cross_reference struct<matched_blocked_domains:array<string>,matched_blocked_urls:array<string>,matched_blocked_channels:array<string>,blocked_entity_count:int>, "
    "ground_truth_label string, ground_truth_category string, ground_truth_source string, data_source string"
)
ADVISORY = "advisory_id string, date string, title string, blocked_domains array<string>, blocked_urls array<string>, blocked_channels array<string>, blocked_upis array<string>, blocked_phones array<string>"
ALERT = "alert_id string, date string, title string, domains array<string>, ips array<string>"
COMPLAINT = "complaint_id string, victim_name string, victim_phone string, district string, scam_type string, description string, loss double, phone string, upi string, url string, telegram string, at timestamp"
AUDIT = "event_id string, timestamp timestamp, officer_id string, username string, badge_number string, district string, action string, resource string, outcome string, prev_hash string, this_hash string"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
