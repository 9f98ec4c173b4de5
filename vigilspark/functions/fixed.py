"""Fixed values of the domain: word lists, lookup tables, thresholds and patterns.

Everything here is data that results depend on; nothing here computes.
"""

from __future__ import annotations

# Scam categories in label order: id, label, group, severity, blocking priority, legal basis, English and Hindi keywords.
CATEGORIES = [
    ("real_money_betting", "Real Money Betting", "financial_fraud", "HIGH", 2, "IT Act §66D + Public Gambling Act 1867",
     ["betting tips", "cricket prediction", "IPL jackpot", "toss winner", "match fixing", "dream11 hack", "casino online", "rummy real money", "satta matka", "win big money"],
     ["सट्टा", "बेटिंग टिप्स", "क्रिकेट भविष्यवाणी", "टॉस विनर", "मैच फिक्सिंग", "जीतो पैसा", "IPL जैकपॉट", "रमी खेलो", "कैसीनो"]),
    ("investment_scam", "Investment Scam", "financial_fraud", "HIGH", 1, "IT Act §66D + IPC §420 + SEBI Act",
     ["guaranteed return", "double money", "invest now", "stock tips", "mutual fund tips", "forex trading", "crypto profit", "ponzi scheme", "zero risk investment", "monthly income"],
     ["गारंटी रिटर्न", "पैसा दुगना", "इन्वेस्ट करो", "स्टॉक टिप्स", "निवेश करें", "मुनाफा पक्का", "हर महीने कमाओ", "ज़ीरो रिस्क"]),
    ("loan_scam", "Fake Loan App", "financial_fraud", "HIGH", 2, "IT Act §66D + RBI Guidelines",
     ["instant loan", "loan approved", "no documents loan", "advance fee", "processing fee", "loan app", "personal loan"],
     ["तुरंत लोन", "लोन अप्रूव्ड", "बिना दस्तावेज़ लोन", "प्रोसेसिंग फी", "एडवांस फी"]),
    ("job_scam", "Job Scam", "financial_fraud", "MEDIUM", 3, "IT Act §66D + IPC §420",
     ["work from home", "earn daily", "part time job", "typing job", "data entry job", "online job", "registration fee", "join now earn"],
     ["घर बैठे कमाओ", "पार्ट टाइम जॉब", "रोज़ कमाओ", "ऑनलाइन काम", "रजिस्ट्रेशन फीस", "टाइपिंग जॉब"]),
    ("lottery_scam", "Lottery / KBC Scam", "financial_fraud", "MEDIUM", 3, "IT Act §66D + IPC §420",
     ["lottery winner", "lucky draw", "KBC winner", "prize money", "congratulations you won", "claim your prize", "WhatsApp lottery"],
     ["लॉटरी विनर", "लकी ड्रॉ", "KBC विनर", "इनाम", "बधाई आपने जीता", "अपना इनाम लो"]),
    ("fake_customer_care", "Fake Customer Care", "impersonation", "HIGH", 1, "IT Act §66C + §66D + IPC §419",
     ["customer care", "helpline number", "toll free", "KYC update", "account suspended", "account blocked", "verify your account", "TRAI notice", "bank alert", "refund process"],
     ["कस्टमर केयर", "हेल्पलाइन", "KYC अपडेट", "अकाउंट सस्पेंड", "अकाउंट ब्लॉक", "TRAI नोटिस", "रिफंड"]),
    ("fake_govt_official", "Fake Government Official", "impersonation", "CRITICAL", 1, "IPC §170 + IT Act §66D + BNS §204",
     ["CBI officer", "ED notice", "police officer", "digital arrest", "arrest warrant", "court order", "FIR registered", "cyber crime branch", "income tax notice", "customs officer"],
     ["CBI अधिकारी", "ED नोटिस", "पुलिस अधिकारी", "डिजिटल अरेस्ट", "गिरफ़्तारी वारंट", "कोर्ट ऑर्डर", "FIR दर्ज", "आयकर नोटिस"]),
    ("fake_celebrity_endorsement", "Fake Celebrity Endorsement", "impersonation", "HIGH", 2, "IT Act §66D + IPC §420 + Copyright Act",
     ["Mukesh Ambani investment", "Ratan Tata scheme", "PM Modi scheme", "endorsed by", "celebrity investment", "famous person recommends"],
     ["मुकेश अंबानी योजना", "रतन टाटा स्कीम", "मोदी योजना", "सेलिब्रिटी इन्वेस्टमेंट"]),
    ("sextortion_threat", "Sextortion / Blackmail", "harmful_content", "CRITICAL", 1, "IT Act §66E + BNS §77 + IT Act §67",
     ["viral your video", "send money or", "blackmail", "intimate video", "leaked photos", "morphed images", "pay or expose", "sextortion"],
     ["वीडियो वायरल", "पैसे भेजो नहीं तो", "ब्लैकमेल", "अश्लील वीडियो", "फोटो लीक", "मॉर्फ्ड इमेज"]),
    ("child_exploitation", "Child Exploitation Material", "harmful_content", "CRITICAL", 1, "POCSO Act §14/15 + IT Act §67B",
     ["child video", "underage", "minor content", "school girl", "child abuse"],
     ["बच्चों का वीडियो", "नाबालिग", "स्कूल लड़की"]),
    ("drug_sale", "Online Drug Sale", "harmful_content", "CRITICAL", 1, "NDPS Act 1985 + IT Act §66",
     ["buy drugs online", "weed delivery", "cannabis", "cocaine", "meth", "darknet market", "drug dealer"],
     ["ड्रग्स ऑनलाइन", "गांजा", "चरस", "नशा"]),
    ("fake_followers_sale", "Fake Followers / Engagement", "platform_violations", "LOW", 4, "IT Act §66 + Platform ToS violation",
     ["buy followers", "buy likes", "Instagram followers", "YouTube subscribers", "fake engagement", "social media growth"],
     ["फॉलोअर्स खरीदो", "लाइक्स खरीदो"]),
    ("counterfeit_products", "Counterfeit Products", "platform_violations", "MEDIUM", 3, "Trademark Act 1999 + Consumer Protection Act 2019",
     ["first copy", "replica watch", "branded cheap", "original at low price", "AAA quality"],
     ["फर्स्ट कॉपी", "ब्रांडेड सस्ता", "ओरिजिनल कम कीमत"]),
    ("piracy_links", "Piracy / Illegal Streaming", "platform_violations", "MEDIUM", 3, "IT Act §66 + Copyright Act 1957 §63",
     ["free movies download", "pirated content", "torrent links", "illegal streaming", "crack software"],
     ["फ्री मूवी डाउनलोड", "पायरेटेड", "टोरेंट लिंक"]),
]
# Legal response by category id: primary section, first report advised, authority, urgency.
LEGAL = {
    "real_money_betting": ("IT Act §66D", True, "I4C", "HIGH"),
    "investment_scam": ("IT Act §66D", True, "I4C + SEBI", "HIGH"),
    "loan_scam": ("IT Act §66D", True, "I4C + RBI", "HIGH"),
    "job_scam": ("IT Act §66D", True, "I4C", "MEDIUM"),
    "lottery_scam": ("IT Act §66D", True, "I4C", "MEDIUM"),
    "fake_customer_care": ("IT Act §66C", True, "I4C + DoT", "HIGH"),
    "fake_govt_official": ("IPC §170", True, "I4C + Local Police", "CRITICAL"),
    "fake_celebrity_endorsement": ("IT Act §66D", True, "I4C + SEBI", "HIGH"),
    "sextortion_threat": ("IT Act §66E", True, "I4C + Local Police", "CRITICAL"),
    "child_exploitation": ("POCSO Act §14/15", True, "I4C + NCPCR + Interpol", "CRITICAL"),
    "drug_sale": ("NDPS Act §20-29", True, "NCB + Local Police", "CRITICAL"),
    "fake_followers_sale": ("IT Act §66", False, "Platform + I4C", "LOW"),
    "counterfeit_products": ("Trademark Act §103", True, "I4C + Brand owner", "MEDIUM"),
    "piracy_links": ("Copyright Act §63", False, "I4C + MEITY", "MEDIUM"),
}

# Whole-word keywords of the heuristic classifier; the first list with a hit gives the label.
HEURISTIC_KEYWORDS = [
    (7, ["mukesh ambani", "ratan tata", "pm modi", "celebrity", "endorse", "endorsed"]),
    (3, ["job", "task", "work from home", "part time", "part-time", "hourly pay", "salary", "daily income", "telegram task"]),
    (1, ["invest", "profit", "return", "double", "guaranteed", "stock", "crypto", "trading", "passive income", "earn money"]),
    (2, ["loan", "instant loan", "credit", "personal loan", "no document", "cash loan", "quick cash"]),
    (0, ["bet", "betting", "aviator", "color prediction", "casino", "gambling", "win money"]),
    (4, ["lottery", "kbc", "won", "prize", "crorepati", "lucky draw", "bumper prize"]),
    (5, ["customer care", "helpline", "support", "bank support", "toll free", "toll-free", "service number"]),
    (6, ["cbi", "ed", "police", "customs", "arrest", "arrest warrant", "digital arrest", "narcotics", "court order"]),
    (8, ["leak", "video leak", "nude", "sextortion", "blackmail", "expose", "morphed", "video viral", "private video"]),
    (11, ["follower", "like", "subscribe", "buy followers", "instagram followers", "youtube views"]),
    (10, ["drug", "weed", "pill", "online pharmacy", "marijuana", "cocaine"]),
    (9, ["child abuse", "child exploitation", "csem"]),
    (12, ["counterfeit", "replica", "copy", "first copy", "fake brand", "fake product"]),
    (13, ["piracy", "download movie", "free stream", "torrent", "leak movie"]),
]

# Patterns of the rule-based category; two different hits are needed, the earlier category wins ties.
RULE_PATTERNS = [
    ("INVESTMENT_SCAM", [
        r"\binvest(?:ment|ing)?\b", r"\bguaranteed\s+return", r"\bdouble\s+(?:your\s+)?money\b", r"\bstock\s+tips?\b",
        r"\bmutual\s+fund\b", r"\bshare\s+market\b", r"\bforex\s+trad", r"\bcrypto\s+profit", r"\bponzi\b", r"\bzero\s+risk\b",
        r"\bmonthly\s+income\b", r"\bpaisa\s+dugna\b", r"\bpakka\s+munafa\b", r"\b\d+%\s*(?:return|profit|daily|guaranteed)\b"]),
    ("BETTING_SCAM", [
        r"\bbetting\s+tips?\b", r"\bcricket\s+predict", r"\bipl\s+(?:jackpot|toss|bet)", r"\bsatta\s+matka\b", r"\bmatch\s+fix",
        r"\btoss\s+winner\b", r"\bcasino\s+online\b", r"\bwin\s+big\s+money\b"]),
    ("DIGITAL_ARREST", [
        r"\bdigital\s+arrest\b", r"\bcbi\s+officer\b", r"\benforcement\s+directorate\b", r"\bed\s+notice\b",
        r"\barrest\s+warrant\b", r"\bcourt\s+order\b", r"\bfir\s+registered\b"]),
    ("IMPERSONATION", [
        r"\bcustomer\s+care\b", r"\bhelpline\s+number\b", r"\bkyc\s+(?:update|verify|expir)", r"\baccount\s+(?:block|suspend|deactivat)",
        r"\btoll\s+free\b", r"\bbank\s+(?:alert|support)\b", r"\btrai\s+notice\b"]),
    ("JOB_SCAM", [
        r"\bwork\s+from\s+home\b", r"\bpart\s+time\s+job\b", r"\bonline\s+(?:job|earn)", r"\btyping\s+job\b",
        r"\bdata\s+entry\s+job\b", r"\bearn\s+daily\b", r"\bregistration\s+fee\b"]),
    ("LOTTERY_SCAM", [
        r"\blottery\s+winner\b", r"\blucky\s+draw\b", r"\bkbc\s+winner\b", r"\bprize\s+money\b",
        r"\bcongratulations?\s+you\s+won\b", r"\bclaim\s+(?:your\s+)?prize\b", r"\bwhatsapp\s+lottery\b"]),
    ("LOAN_SCAM", [
        r"\binstant\s+loan\b", r"\bloan\s+app(?:roved)?\b", r"\bno\s+document\s+loan\b", r"\badvance\s+fee\b", r"\bprocessing\s+fee\b"]),
]

# Urgency, backup and impersonation keyword lists (plain substrings of the lower-cased text).
URGENCY_FULL = [
    "urgent", "hurry", "last chance", "limited time", "act now", "don't miss", "final warning", "only today", "expires",
    "guaranteed", "double money", "free", "winner", "claim now", "immediately", "right now", "don't delay",
    "जल्दी", "तुरंत", "अभी", "सीमित समय", "आखिरी मौका", "गारंटी", "पैसा दुगना", "फ्री", "विजेता", "अभी क्लेम करो", "देर न करें", "जल्दी करो",
]
# two mixed-case entries of the evidence list never match lower-cased text; they are left as they are
URGENCY_EVIDENCE = [
    "urgent", "hurry", "last chance", "limited time", "act now", "guaranteed", "double money", "free", "winner", "claim now",
    "immediately", "don't delay", "jaldi", "turant", "abhi", "aakhiri mauka", "garanTi", "paisa dugna",
]
URGENCY_DECISION = ["urgent", "limited", "hurry", "last chance", "act now", "guaranteed", "जल्दी", "तुरंत", "अभी"]
BACKUP_FULL = ["backup", "back up", "new channel", "moved to", "join new", "alternative", "बैकअप", "नया चैनल"]
BACKUP_EVIDENCE = ["backup", "new channel", "moved to", "join new", "alternative"]
BACKUP_DECISION = ["backup", "new channel", "moved to", "बैकअप"]
IMPERSONATION = [
    ("sbi", "State Bank of India"), ("rbi", "Reserve Bank of India"), ("cbi", "Central Bureau of Investigation"),
    ("ed", "Enforcement Directorate"), ("paytm", "Paytm"), ("phonepe", "PhonePe"), ("google pay", "Google Pay"),
    ("airtel", "Airtel"), ("customer care", "Customer Care Impersonation"), ("helpline", "Official Helpline Impersonation"),
    ("aadhaar", "UIDAI / Aadhaar"), ("income tax", "Income Tax Department"), ("digital arrest", "Law Enforcement Impersonation"),
]
SCAM_CONTEXT = [
    "call now", "call us", "contact", "helpline", "support", "blocked", "suspended", "deactivated", "verify", "update kyc",
    "click here", "pay now", "pay fine", "penalty", "arrest", "immediately", "urgent", "warning", "freeze",
]
FINANCIAL_PROMISES = [
    r"\d+%\s*(?:return|profit|daily|monthly|guaranteed)", r"double\s+(?:your\s+)?money", r"paisa\s+dugna", r"guaranteed\s+(?:return|income|profit)",
]

# Investment promises, type and pattern, English then Hindi.
PROMISES = [
    ("RETURN_PERCENT", "ENGLISH", r"(\d+)\s*%\s*(?:return|profit|interest|earning)"),
    ("GUARANTEED", "ENGLISH", r"(?:guaranteed|pakka|100%)\s*(?:return|profit|income|earning)"),
    ("DOUBLE_MONEY", "ENGLISH", r"double\s*(?:your)?\s*(?:money|investment|amount)\s*(?:in)?\s*(\d+)?\s*(?:day|hour|week|month)?"),
    ("DAILY_EARNING", "ENGLISH", r"(?:earn|make|get)\s*(?:₹|Rs\.?|INR|rs\.?)?\s*(\d[\d,]*)\s*(?:per|every|daily|monthly|per\s*day)"),
    ("DAILY_EARNING", "ENGLISH", r"(?:minimum|min)\s*(?:₹|Rs\.?)?\s*(\d[\d,]*)\s*(?:return|profit|income)"),
    ("RETURN_PERCENT", "ENGLISH", r"(?:invest|deposit)\s*(?:₹|Rs\.?)?\s*(\d[\d,]*)\s*(?:and|&)\s*(?:get|earn|receive)\s*(?:₹|Rs\.?)?\s*(\d[\d,]*)"),
    ("RETURN_PERCENT", "ENGLISH", r"(\d+)x\s*(?:return|profit|growth)"),
    ("RETURN_PERCENT", "HINDI", r"(\d+)\s*(?:गुना|guna)\s*(?:return|profit|munafa|फ़ायदा|फायदा|लाभ)"),
    ("GUARANTEED", "HINDI", r"(?:guaranteed|pakka|पक्का)\s*(?:munafa|फ़ायदा|फायदा|लाभ|कमाई|income)"),
    ("DOUBLE_MONEY", "HINDI", r"(?:paisa|पैसा|money)\s*(?:double|दुगना|dugna|दोगुना|doguna)"),
    ("DAILY_EARNING", "HINDI", r"(?:roz|daily|रोज़|हर\s*दिन)\s*(?:₹|Rs\.?)?\s*(\d[\d,]*)\s*(?:kamao|कमाओ|earn|income)"),
    ("DAILY_EARNING", "HINDI", r"(?:sirf|only|बस)\s*(?:₹|Rs\.?)?\s*(\d[\d,]*)\s*(?:invest|lagao|लगाओ)"),
]

# Digits written as words (English, romanised Hindi, frequent misreads) and what introduces a number.
WORD_DIGITS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "shunya": "0", "ek": "1", "do": "2", "teen": "3", "char": "4", "paanch": "5", "panch": "5", "chhah": "6", "chhe": "6",
    "saat": "7", "sat": "7", "aath": "8", "aat": "8", "nau": "9", "noh": "9", "o": "0", "oh": "0", "l": "1", "i": "1",
}
NUMBER_TRIGGER = r"(?:call|dial|contact|whatsapp|number|phone|no\.?|num)\s*[:.]?\s*"

# Entity patterns.
PHONE = r"(?:(?:\+91|91|0)[-.\s]?)?[6-9]\d{9}"
PHONE_DISGUISED = r"[6-9][\d\sOoIl+\-_.]{10,25}"
PHONE_WHATSAPP = r"(?i)wa\.me/(?:91)?(\d{10})"
UPI = r"[a-zA-Z0-9._-]+@[a-zA-Z]{2,}"
MAIL_PROVIDERS = ["gmail", "yahoo", "hotmail", "outlook", "email", "proton"]
URL = r"(?i)https?://[^\s<>\"']+|(?:bit\.ly|t\.me|wa\.me|goo\.gl|tinyurl\.com|is\.gd|cutt\.ly|rb\.gy|short\.io)/[a-zA-Z0-9_-]+"
TELEGRAM_LINK = r"(?i)(?:https?://)?t\.me/([a-zA-Z0-9_]+(?:/\d+)?)"
TELEGRAM_MENTION = r"@([a-zA-Z][a-zA-Z0-9_]{4,})"
# Patterns of the post collector, which knows its payment handles by name.
COLLECTED_PHONE = r"(?:\+91[\-\s]?)?[6-9]\d{4}[\-\s]?\d{5}"
COLLECTED_HANDLES = [
    "upi", "paytm", "oksbi", "okaxis", "okicici", "okhdfcbank", "ybl", "ibl", "axl", "sbi", "icici", "hdfc", "kotak", "apl", "boi", "citi", "indus",
    "freecharge", "phonepe", "gpay", "amazonpay", "jupiteraxis", "slice", "fi", "niyoicici",
]
COLLECTED_UPI = r"(?i)[a-zA-Z0-9._\-]+@(?:" + "|".join(COLLECTED_HANDLES) + r")\b"
COLLECTED_URL = r"https?://[^\s<>\"']+|(?:www\.)[^\s<>\"']+"
COLLECTED_LINK = r"(?:https?://)?t\.me/(?:joinchat/)?[a-zA-Z0-9_]+|@[a-zA-Z][a-zA-Z0-9_]{3,}"
WHATSAPP_GROUP = r"(?i)(?:https?://)?chat\.whatsapp\.com/([a-zA-Z0-9]{15,})"
BANK_WORDS = r"(?i)(?:account|a/c|acc|bank|deposit|transfer|neft|rtgs|imps)"
BANK_ACCOUNT = r"\b(\d{9,18})\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)\s*(\d[\d,]*(?:\.\d{1,2})?)|(\d[\d,]*(?:\.\d{1,2})?)\s*(?:₹|Rs\.?|INR|rupees?)"
MASKS = [
    (r"(\+91[-\s]?)?[6-9]\d{9}", "***PHONE***"), (r"\b[a-zA-Z0-9._-]+@[a-zA-Z]{2,10}\b", "***UPI***"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***EMAIL***"), (r"\b\d{4}\s?\d{4}\s?\d{4}\b", "***AADHAAR***"),
    (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "***PAN***"), (r"\b\d{9,18}\b", "***ACCOUNT***"),
]
IOC_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:com|in|org|net|co\.in|io|xyz|online|site|info|biz|club|tech|top)\b"
IOC_IP = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
IOC_CVE = r"(?i)CVE-\d{4}-\d{4,}"
LEGAL_CITATION = r"(?i)(?:IT\s*Act|Information\s*Technology\s*Act)\s*(?:,?\s*(?:Section|§|Sec\.?)\s*\d+[A-Z]?(?:\s*[/&]\s*\d+[A-Z]?)*)"
# Patterns and own domains of advisory and alert publishers, payment handles of alerts.
ADVISORY_URL = r"https?://[^\s<>\"']+"
ADVISORY_DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:com|in|org|net|co\.in|io|xyz|online|site|info|biz|club)\b"
ADVISORY_CHANNEL = r"(?:https?://)?t\.me/[a-zA-Z0-9_]+"
ADVISORY_OWN = ["cybercrime.gov.in", "cert-in.org"]
ALERT_OWN = ["cert-in.org", "gov.in", "nic.in"]
ALERT_UPI = (
    r"(?i)[a-zA-Z0-9._\-]+@(?:upi|paytm|oksbi|okaxis|okicici|okhdfcbank|ybl|ibl|axl|sbi|icici|hdfc|kotak|apl|boi|citi|indus|"
    r"freecharge|phonepe|gpay|amazonpay)\b"
)
# General indicators of a classified text.
GENERAL_INDICATORS = [
    (r"\+91|wa\.me|t\.me", "Contains contact information (phone/messaging links)"), (r"@\w+", "Contains UPI ID or social media handle"),
    (r"₹|Rs\.?\s*\d", "Contains monetary amounts"),
]
# What the address of a crypto payment page holds.
CRYPTO_WORDS = ["bitcoin", "btc", "eth", "usdt"]
QR_MENTION = r"(?i)\bQR\s*code\b|\bQR\b|\bscan\s*(?:the\s*)?code\b"
EMOJI = (
    "[\U0001f600-\U0001f64f\U0001f300-\U0001f5ff\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff✂-➰"
    "\U0001fa00-\U0001fa6f\U0001fa70-\U0001faff]+"
)

# Advisory types and alert severities by keyword, first match wins.
VIOLATIONS = [
    ("FINANCIAL_FRAUD", ["investment", "ponzi", "trading", "stock", "crypto", "loan", "financial fraud", "money doubling"]),
    ("BETTING_GAMBLING", ["betting", "gambling", "satta", "matka", "cricket", "casino", "rummy"]),
    ("IMPERSONATION", ["impersonat", "fake customer care", "fake helpline", "digital arrest", "fake officer"]),
    ("SEXTORTION", ["sextortion", "blackmail", "intimate", "morphed"]),
    ("CHILD_EXPLOITATION", ["child", "minor", "csam", "pocso"]),
    ("DRUG_TRAFFICKING", ["drug", "narcotic", "ndps"]),
    ("PIRACY", ["piracy", "copyright", "pirated", "torrent"]),
    ("FAKE_APP", ["fake app", "malicious app", "rogue app"]),
]
SEVERITY_WORDS = [
    ("CRITICAL", ["critical", "urgent", "emergency", "zero-day", "0-day"]), ("HIGH", ["high", "important", "severe"]),
    ("MEDIUM", ["medium", "moderate"]), ("LOW", ["low", "informational"]),
]

# Role indicators and weights; the first best role wins.
ROLES = [
    ("ADMIN", 1.0, ["pinned messages", "welcome message", "rules", "adds members", "changes group description", "admin rights", "बॉस", "संचालक"]),
    ("RECRUITER", 0.9, ["join now", "click link", "dm for details", "limited slots", "free joining", "abhi join karo", "अभी जुड़ें", "link click", "forward this", "share karo"]),
    ("VICTIM_HANDLER", 0.85, ["profit screenshot", "withdrawal proof", "trust me", "your account ready", "customer support", "helpline", "आपका अकाउंट", "मुनाफा", "withdraw karo"]),
    ("MONEY_MULE", 0.9, ["paytm karo", "gpay", "upi transfer", "send amount", "payment received", "amount bhejo", "पैसे भेजो", "account number", "transfer", "deposit"]),
    ("CONTENT_DISTRIBUTOR", 0.7, ["forward", "share", "copy paste", "broadcast", "viral karo", "all groups", "sabko bhejo"]),
]
ROLE_ENTITY = r"\+91|\d{10}|@\w+|₹|\d+%"

# Campaign names and categories by pattern, first match wins; places that are named.
CAMPAIGN_NAMES = [
    ("IPL Betting Ring", r"\bipl\b|cricket|betting|match|satta"),
    ("Fake Investment Network", r"zerodha|angel|groww|upstox|stock|invest|mutual fund"),
    ("Digital Arrest Ring", r"digital arrest|cbi|ed |enforcement|aadhaar"),
    ("Fake Customer Care Network", r"customer care|helpline|bank|atm|otp"),
    ("Job Scam Ring", r"job|vacancy|hiring|work from home|घर से काम"),
    ("Lottery Scam Network", r"lottery|prize|won|winner|congratulation"),
]
CAMPAIGN_CATEGORIES = [
    ("Investment Scam", r"invest|return|profit|mutual fund"), ("Real Money Betting", r"betting|cricket|ipl|satta"),
    ("Digital Arrest", r"arrest|cbi|ed |court|warrant"), ("Fake Customer Care", r"customer care|helpline|bank"),
    ("Job Scam", r"job|hiring|vacancy"), ("Lottery Scam", r"lottery|prize|winner"),
]
PLACES = r"\b(gurugram|delhi|mumbai|hyderabad|bengaluru|jamtara|noida)\b"
PLAYBOOKS = [("Investment Scam", 9), ("Real Money Betting", 7), ("Digital Arrest", 7), ("Fake Customer Care", 4), ("Sextortion", 6)]

# Intent keywords.
INVESTMENT_WORDS = [
    "invest", "return", "profit", "double", "guaranteed", "stock", "mutual fund", "forex", "crypto", "trading", "scheme", "plan",
    "earn", "income", "लाभ", "निवेश", "मुनाफा", "रिटर्न", "कमाई", "पैसा दुगना",
]
SEXTORTION_WORDS = [
    "viral your video", "leak your photos", "send money", "blackmail", "intimate content", "morphed", "nude", "expose you",
    "private video", "pay or else", "screenshot saved", "recorded you", "share everywhere",
    "वीडियो वायरल कर दूंगा", "फोटो लीक", "पैसे भेजो", "ब्लैकमेल", "अश्लील", "payment karo", "paisa bhejo", "viral kar dunga", "nahi toh", "expose",
]
ARREST_WORDS = [
    "digital arrest", "arrest warrant", "fir registered", "court order", "summons", "digital custody", "verification pending",
    "case registered", "money laundering", "suspicious transaction", "parcel seized", "drug found", "aadhaar linked",
    "डिजिटल अरेस्ट", "गिरफ़्तारी वारंट", "FIR दर्ज", "कोर्ट ऑर्डर", "सम्मन", "पार्सल सीज़",
]
CELEBRITIES = [
    ("Mukesh Ambani", "BUSINESS", ["Ambani", "Mukesh Dhirubhai Ambani"]), ("Ratan Tata", "BUSINESS", ["Tata", "Ratan Naval Tata"]),
    ("Gautam Adani", "BUSINESS", ["Adani", "Adani Group"]), ("Narendra Modi", "POLITICS", ["PM Modi", "Modi ji", "Modi", "NaMo"]),
    ("Amit Shah", "POLITICS", ["Shah", "Home Minister"]), ("Amitabh Bachchan", "ENTERTAINMENT", ["Amitabh", "Big B", "Bachchan", "KBC host"]),
    ("Shah Rukh Khan", "ENTERTAINMENT", ["SRK", "Shah Rukh", "King Khan"]), ("Salman Khan", "ENTERTAINMENT", ["Salman", "Bhai"]),
    ("Virat Kohli", "SPORTS", ["Kohli", "King Kohli", "Virat"]), ("MS Dhoni", "SPORTS", ["Dhoni", "MSD", "Captain Cool", "Mahi"]),
    ("Sachin Tendulkar", "SPORTS", ["Sachin", "Master Blaster", "Tendulkar"]), ("Rohit Sharma", "SPORTS", ["Rohit", "Hitman", "Ro"]),
    ("CBI Director", "GOVT_OFFICIAL", ["CBI Officer", "CBI Inspector"]), ("ED Officer", "GOVT_OFFICIAL", ["Enforcement Directorate", "ED Director"]),
    ("Income Tax Officer", "GOVT_OFFICIAL", ["IT Department", "Tax Officer", "IRS Officer"]),
    ("Customs Officer", "GOVT_OFFICIAL", ["Customs Department", "Airport Customs"]),
]
CELEBRITY_WORDS = [word.lower() for name, _, aliases in CELEBRITIES for word in (name, *aliases)]

# Numbering plan and payment handles.
JIO_PREFIXES = ["6000", "6001", "6002", "6003", "6004", "6005", "7000", "7001"]
CARRIERS = [
    ("Jio", ["60", "61", "71"]), ("Airtel", ["70", "73", "74", "75", "80", "81"]),
    ("Vi", ["62", "63", "77", "78", "82", "83", "84", "85", "86", "87"]), ("BSNL/MTNL", ["90", "91", "92", "93", "94", "95"]),
]
OPERATORS = [("Jio", "Reliance Jio"), ("Airtel", "Bharti Airtel"), ("Vi", "Vodafone Idea"), ("BSNL/MTNL", "BSNL/MTNL")]
RISKY_CIRCLES = ["Jharkhand", "Bihar"]
CIRCLES = [("98", "Delhi"), ("99", "Delhi"), ("70", "Mumbai"), ("80", "Karnataka"), ("94", "Tamil Nadu"), ("63", "Jharkhand"), ("83", "Bihar")]
UPI_BANKS = [
    ("paytm", "Paytm Payments Bank"), ("gpay", "Google Pay"), ("oksbi", "SBI"), ("okaxis", "Axis Bank"), ("ybl", "PhonePe"),
    ("okhdfcbank", "HDFC Bank"), ("okicici", "ICICI Bank"),
]
FREEZE_BANKS = [
    ("paytm", "Paytm Payments Bank"), ("gpay", "Google Pay (Axis Bank)"), ("oksbi", "State Bank of India"), ("okaxis", "Axis Bank"),
    ("okhdfcbank", "HDFC Bank"), ("okicici", "ICICI Bank"), ("ybl", "PhonePe (Yes Bank)"), ("ibl", "ICICI Bank"), ("upi", "Generic UPI"),
    ("apl", "Amazon Pay"), ("ratn", "RBL Bank"), ("kotak", "Kotak Mahindra Bank"),
]
SHORTENERS = ["bit.ly", "tinyurl.com", "is.gd", "goo.gl", "t.co", "rb.gy", "shorturl.at"]
URL_SCAM_WORDS = ["invest", "earn", "money", "withdraw", "profit", "guaranteed", "double"]
SUSPICIOUS_TLDS = [".xyz", ".top", ".work", ".click", ".buzz", ".gq", ".ml"]
DECISION_TLDS = [".xyz", ".online", ".site", ".top", ".club"]
QR_RISK = [("UPI_PAYMENT", 0.7), ("TELEGRAM", 0.8), ("WHATSAPP", 0.75), ("PHONE", 0.6), ("URL", 0.5)]

# Text corrections after recognition.
DEVANAGARI_FIXES = [("ाी", "ी"), ("ंं", "ं"), ("ंा", "ां"), ("ाे", "ो"), ("ाै", "ौ"), ("ि्", "ि")]
DIGIT_FIXES = [(r"(\d)O(\d)", "$10$2"), (r"(\d)o(\d)", "$10$2"), (r"(\d)[Il](\d)", "$11$2"), (r"(\d)S(\d)", "$15$2"), (r"(\d)B(\d)", "$18$2")]
HINDI_WORD_FIXES = [
    ("पेसे", "पैसे"), ("कमाई्", "कमाई"), ("इन्वेस्टमेन्ट", "इन्वेस्टमेंट"), ("गॅरन्टी", "गारंटी"), ("प्राॅफिट", "प्रॉफिट"),
    ("कस्टमर्", "कस्टमर"), ("हेल्पलाइन्", "हेल्पलाइन"), ("बेटिंग्", "बेटिंग"),
]
LATIN_FIXES = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u")]

# Ordered thresholds.
DECISIONS = [(85, "BLOCK"), (70, "ESCALATE"), (50, "INVESTIGATE"), (30, "MONITOR")]
RISK_LEVELS = [(75, "CRITICAL"), (50, "HIGH"), (25, "MEDIUM")]
ATTRIBUTION_STRENGTHS = [(0.95, "DEFINITIVE"), (0.80, "STRONG"), (0.60, "PROBABLE"), (0.40, "POSSIBLE")]
STRENGTH_RANK = [("DEFINITIVE", 5), ("STRONG", 4), ("MODERATE", 3), ("WEAK", 2), ("CIRCUMSTANTIAL", 1)]
ATTRIBUTION = {"prior": -4.0, "infrastructure": 3.0, "behavioral": 1.0, "temporal": 2.0, "content": 0.5, "interaction": 1.5}
INFRA_WEIGHTS = {"upi": 0.40, "phone": 0.30, "domain": 0.20, "image": 0.10}
DECAY_HOURS = 48.0
EXPECTED_FIELDS = ["posts", "entities_found", "channel_metadata", "posting_schedule", "language_distribution", "media_ratio", "growth_snapshots"]
ALERT_THRESHOLDS = {"new_channels_24h": 5, "estimated_reach": 10_000, "platforms": 3, "campaign_count": 5, "activity_multiplier": 3}

# Departments that are impersonated, by words, and words that tell what a manipulated image is for.
DEPARTMENTS = [
    ("CBI", ["cbi", "central bureau", "investigation bureau"]), ("ED", ["enforcement directorate", "ed ", "ed notice", "ecir"]),
    ("Police", ["police", "cyber crime", "crime branch", "thana", "sho"]), ("Income Tax", ["income tax", "it department", "tax notice", "itr"]),
    ("Customs", ["customs", "excise", "parcel", "courier seized"]), ("TRAI", ["trai", "telecom", "sim deactivate", "mobile number"]),
    ("RBI", ["rbi", "reserve bank", "banking fraud"]), ("Court", ["court", "judge", "magistrate", "judicial"]),
    ("NIA", ["nia", "national investigation"]), ("NCB", ["ncb", "narcotics"]),
]
OFFICIAL_WORDS = ["cbi", "ed ", "police", "officer", "inspector", "customs", "income tax", "court", "judge"]
USE_SEXTORTION = ["viral", "leak", "nude", "intimate", "blackmail", "payment karo", "पैसे भेजो", "वीडियो वायरल", "expose", "morphed", "private video"]
USE_ARREST = [
    "digital arrest", "arrest warrant", "fir registered", "court order", "cbi", "ed notice", "cyber crime branch", "डिजिटल अरेस्ट",
    "गिरफ़्तारी", "digital custody", "verification pending",
]
USE_INVESTMENT = ["invest", "return", "profit", "double", "guaranteed", "stock", "mutual fund", "crypto", "trading", "निवेश", "मुनाफा", "रिटर्न"]
CLAIMS = [
    r"(?i)(?:invest|earn|return|profit|guaranteed).{0,100}", r"(?i)(?:₹|Rs\.?|INR)\s*\d[\d,]*.*?(?:return|profit|daily|monthly)",
    r"(?i)\d+\s*%\s*(?:return|profit|interest)", r"(?i)double\s+your\s+money.{0,50}",
]
DOMAIN_WORDS = ["invest", "money", "earn", "win", "bet", "stock"]
OCR_FIXES = [("l<", "k"), ("|", "l"), ("0", "O"), ("rn", "m"), ("vv", "w"), ("Rs ", "Rs."), ("Rs,", "Rs."), ("INFt", "INR")]
