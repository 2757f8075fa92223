"""Fixed values of the detectors, as the analysed product states them: patterns, triggers and word lists."""

from __future__ import annotations

MIN_DIGITS = 6

#: Words that count as a digit.
DIGIT_WORDS = (
    "zero", "oh", "nought", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "double", "triple",
)

#: Detector, category, pattern over the display text. ``(?U)`` gives classes and edges their Unicode meaning.
PATTERNS = (
    ("email_pattern", "contact", r"(?U)\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("url_pattern", "contact", r"(?iuU)\bhttps?://\S+|\bwww\.[\w-]+\.[\w.]{2,}\S*"),
    ("ipv4_pattern", "account_identifier", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("us_ssn_pattern", "government_id", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("fi_hetu_pattern", "government_id", r"(?U)\b\d{6}[-+ABCDEFYXWVU]\d{3}[0-9A-Z]\b"),
    ("secret_prefix_pattern", "credential_secret", r"(?U)\b(?:sk|pk|rk)[-_][A-Za-z0-9_-]{12,}\b|\bAKIA[0-9A-Z]{12,}\b|\bgh[pousr]_[A-Za-z0-9]{16,}\b|\bxox[baprs]-[A-Za-z0-9-]{10,}\b|\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("street_address_pattern", "address", r"(?iuU)\b\d{1,5}[a-z]?\s+(?:[A-Z][\w'-]+\s+){0,3}(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|way|court|ct|place|pl|terrace|square|katu|tie|gatan|vagen|strasse|str)\b"),
    ("postcode_pattern", "address", r"(?U)\b(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}|\d{5}(?:-\d{4})?)\b"),
)
#: Patterns whose matches are tested further.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
IBAN = r"(?U)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{2,4}){2,8}\b"
CARD = r"(?U)\b(?:\d[ -]?){12,18}\d\b"
DIGIT_RUN = r"(?U)\+?\d[\d\s().\-]{5,}\d"

#: Patterns of attempts to instruct the classifier, over the lower-cased text.
INJECTION = (
    r"(?U)\bignore (all |any |the )?(previous|prior|above|earlier) (instructions|rules|prompts?)\b",
    r"(?U)\bdisregard (the |all |any )?(instructions|rules|policy|filter)\b",
    r"(?U)\b(you are|act as|pretend to be) (now )?(a|an) \w+",
    r"(?U)\b(do not|don't) (redact|remove|filter|drop)\b",
    r"(?U)\bmark (this|everything|it) as (safe|clean|not sensitive)\b",
    r"(?U)\bsystem prompt\b",
    r"(?U)\bend of (transcript|instructions)\b",
)

#: Phrase, category, words that follow, detector.
TRIGGERS = (
    ("my name is", "direct_identifier", 3, "name_introduction"), ("this is", "direct_identifier", 2, "name_introduction_weak"), ("call me", "direct_identifier", 2, "name_introduction_weak"),
    ("phone number", "contact", 14, "phone_trigger"), ("mobile number", "contact", 14, "phone_trigger"), ("email address", "contact", 14, "email_trigger"), ("my email", "contact", 14, "email_trigger"),
    ("my address", "address", 16, "address_trigger"), ("home address", "address", 16, "address_trigger"), ("postal code", "address", 8, "address_trigger"), ("post code", "address", 8, "address_trigger"), ("zip code", "address", 8, "address_trigger"),
    ("account number", "account_identifier", 16, "account_trigger"), ("customer number", "account_identifier", 16, "account_trigger"), ("invoice number", "account_identifier", 16, "account_trigger"),
    ("order number", "account_identifier", 16, "account_trigger"), ("reference number", "account_identifier", 16, "account_trigger"),
    ("social security number", "government_id", 14, "government_id_trigger"), ("national identification", "government_id", 14, "government_id_trigger"), ("personal identity code", "government_id", 14, "government_id_trigger"),
    ("passport number", "government_id", 14, "government_id_trigger"), ("driver's licence", "government_id", 14, "government_id_trigger"), ("drivers license", "government_id", 14, "government_id_trigger"),
    ("date of birth", "direct_identifier", 10, "dob_trigger"), ("born on", "direct_identifier", 8, "dob_trigger"),
    ("credit card", "financial", 20, "card_trigger"), ("debit card", "financial", 20, "card_trigger"), ("card number", "financial", 20, "card_trigger"), ("security code", "financial", 8, "card_trigger"),
    ("bank account", "financial", 20, "bank_trigger"), ("iban", "financial", 20, "iban_trigger"), ("sort code", "financial", 10, "bank_trigger"), ("routing number", "financial", 12, "bank_trigger"),
    ("my password", "credential_secret", 12, "credential_trigger"), ("password is", "credential_secret", 12, "credential_trigger"), ("passphrase", "credential_secret", 12, "credential_trigger"),
    ("pin code", "credential_secret", 8, "credential_trigger"), ("pin is", "credential_secret", 8, "credential_trigger"), ("api key", "credential_secret", 16, "credential_trigger"),
    ("access token", "credential_secret", 16, "credential_trigger"), ("secret key", "credential_secret", 16, "credential_trigger"), ("private key", "credential_secret", 16, "credential_trigger"),
    ("two factor code", "credential_secret", 8, "credential_trigger"), ("verification code", "credential_secret", 8, "credential_trigger"), ("one time code", "credential_secret", 8, "credential_trigger"),
)

#: Words of a sensitive kind.
LEXICONS = (
    ("lexicon_health", "health", (
        "diagnosis", "diagnosed", "prescription", "prescribed", "chemotherapy", "cancer", "tumour", "tumor", "hiv", "aids", "diabetes", "depression", "depressed", "anxiety", "psychiatrist", "psychiatric", "therapist",
        "therapy", "antidepressants", "medication", "miscarriage", "pregnant", "pregnancy", "disability", "disabled", "hospitalised", "hospitalized", "overdose", "addiction", "relapse", "symptoms", "biopsy",
    )),
    ("lexicon_political_religious", "political_religious", (
        "voted", "voting", "communist", "socialist", "conservative", "liberal", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "church", "mosque", "synagogue", "baptised", "baptized", "converted",
        "union", "unionised", "unionized", "activist",
    )),
    ("lexicon_sexuality", "sexuality", ("gay", "lesbian", "bisexual", "transgender", "queer", "asexual", "heterosexual", "homosexual", "coming-out")),
)
