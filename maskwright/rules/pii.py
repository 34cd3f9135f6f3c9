"""Rules and word lists for personal data."""

from __future__ import annotations

from .model import SpanRule

# --- fixed values: labels, patterns, scores, context words and word lists must
# --- equal the established ones for results to match.

ENTITY_LABELS = {
    "PERSON": "NAME",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "PHONE",
    "IBAN": "IBAN",
    "CREDIT_CARD": "CREDIT_CARD",
    "PASSPORT": "PASSPORT",
    "NATIONAL_ID": "NATIONAL_ID",
    "IP_ADDRESS": "IP_ADDRESS",
    "URL": "URL",
    "DATE": "DATE",
    "VEHICLE": "VEHICLE",
    "LOCATION": "LOCATION",
    "ORGANIZATION": "ORG",
    "MEDICAL_LICENSE": "MEDICAL_ID",
    "US_BANK_NUMBER": "BANK_ACCOUNT",
    "US_DRIVER_LICENSE": "DRIVER_LICENSE",
    "NRP": "NRP",
}

DOCUMENT_ENTITIES = tuple(ENTITY_LABELS)

SEPARATORS = "━─═—=_*#~│┃"

NAME_DENYLIST = (
    "personal", "information", "employment", "details", "medical", "vehicle",
    "personal information", "employment details", "medical information",
    "vehicle information", "full name", "job title", "full", "title",
    "nationality", "department", "prepared", "bank name", "account name",
    "date issued", "document reference", "visa type",
)
LOCATION_DENYLIST = ("mobile", "emirates")
STRUCTURAL_IDS = (r"^EMP\d+$", r"^[A-Z]{2,5}\d{1,6}$")

CONTEXT = {
    "IBAN": ("iban", "bank", "account", "transfer"),
    "PHONE_NUMBER": ("phone", "mobile", "cell", "tel", "contact", "call", "fax", "alt"),
    "CREDIT_CARD": ("card", "credit", "debit", "visa", "mastercard", "payment"),
    "PASSPORT": ("passport", "travel", "document", "nationality"),
    "NATIONAL_ID": ("id", "national", "identity", "ssn", "emirates", "civil"),
    "IP_ADDRESS": ("ip", "address", "server", "host", "network"),
    "DATE": ("date", "born", "dob", "birthday", "issued", "expiry", "expires"),
    "VEHICLE": ("car", "vehicle", "plate", "registration", "vin", "license plate"),
    "EMAIL_ADDRESS": ("email",),
    "PERSON": ("name", "contact", "manager"),
    "LOCATION": ("address", "city", "country"),
    "NRP": ("nationality",),
    "MEDICAL_LICENSE": ("medical", "certificate", "license"),
    "US_BANK_NUMBER": ("bank", "account", "check", "save"),
    "US_DRIVER_LICENSE": ("driver", "license", "permit"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?"
    r"|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)

# (entity, rule, score in hundredths, pattern)
_PATTERNS = (
    ("IBAN", "IBAN", 95, r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){1,7}(?:\s?[A-Z0-9]{1,4})?\b"),
    ("PHONE_NUMBER", "PHONE_INTL_PLUS", 75, r"(?<![A-Z0-9])\+\d[\d\s\-().]{6,20}\d"),
    ("PHONE_NUMBER", "PHONE_LOCAL", 60,
     r"(?<![A-Z0-9])(?:\(\d{2,4}\)[\s\-]?)?\d{2,4}[\s\-]\d{3,4}[\s\-]\d{3,4}(?!\d)"),
    ("CREDIT_CARD", "CREDIT_CARD_EXTENDED", 85,
     r"(?<![A-Z]{2}\d{2}\s)(?<![A-Z]{2}\d{2})"
     r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}"
     r"|6(?:011|5[0-9]{2})[0-9]{12}|(?:\d{4}[- ]){3}\d{4})\b"),
    ("PASSPORT", "PASSPORT_US", 60, r"\b[A-Z]{1}[0-9]{8}\b"),
    ("PASSPORT", "PASSPORT_UK", 50, r"\b[0-9]{9}\b"),
    ("PASSPORT", "PASSPORT_INTL", 65, r"\b[A-Z]{2}[0-9]{7}\b"),
    ("NATIONAL_ID", "SSN", 85, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("NATIONAL_ID", "UAE_ID", 95, r"\b784-\d{4}-\d{7}-\d{1}\b"),
    ("NATIONAL_ID", "NATIONAL_ID", 60, r"\b[A-Z]{1,2}\d{6,9}[A-Z]?\b"),
    ("IP_ADDRESS", "IPV4", 85, rf"\b{IPV4}\b"),
    ("IP_ADDRESS", "IPV6", 85, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("URL", "URL_WITH_SCHEME", 85, r"(?<!\S)https?://[^\s/$.?#][^\s]*(?!\S)"),
    ("URL", "URL_WWW", 75, r"(?<!\S)www\.[a-zA-Z0-9\-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?(?!\S)"),
    ("DATE", "DATE_DMY", 60, r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("DATE", "DATE_LONG", 75, rf"\b\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\b"),
    ("DATE", "DATE_ISO", 70, r"\b\d{4}-\d{2}-\d{2}\b"),
    ("VEHICLE", "PLATE_UK", 70, r"\b[A-Z]{2}\d{2}\s?[A-Z]{3}\b"),
    ("VEHICLE", "PLATE_US", 50, r"\b[A-Z0-9]{2,3}[- ]?[A-Z0-9]{3,4}\b"),
    ("VEHICLE", "VIN", 75, r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    ("EMAIL_ADDRESS", "EMAIL", 100, r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b"),
    ("MEDICAL_LICENSE", "MEDICAL_LICENSE", 40, r"\b[A-Za-z]{2}\d{7}\b"),
    ("US_BANK_NUMBER", "US_BANK_NUMBER", 40, r"\b[0-9]{8,17}\b"),
    ("US_DRIVER_LICENSE", "US_DRIVER_LICENSE", 40, r"\b[A-Z]\d{6,8}\b"),
)
# Two to four title-case words after a name label; names of accounts are not people.
_NAME_AFTER_LABEL = (
    r"(?<!Account )(?<!Bank )\b(?:Name|Contact|Manager|Prepared by)[ \t]*:[ \t]*"
    r"(\p{Lu}\p{L}+(?:[ \t]\p{Lu}\p{L}+){1,3})"
)
# --- end of fixed values

OFF_BY_DEFAULT = ("VEHICLE", "ORGANIZATION")

# Literals that every match of a rule contains.
_NEEDS = {
    "PHONE_INTL_PLUS": ("+",),
    "URL_WITH_SCHEME": ("http",),
    "URL_WWW": ("www.",),
    "EMAIL": ("@",),
    "IPV6": (":",),
    "UAE_ID": ("784-",),
    "SSN": ("-",),
    "DATE_ISO": ("-",),
    "DATE_DMY": ("/", "-"),
}
# Shortest run of digits that every match of a rule contains.
_DIGITS = {
    "IBAN": 2, "PHONE_LOCAL": 3, "CREDIT_CARD_EXTENDED": 4, "PASSPORT_US": 8, "PASSPORT_UK": 9,
    "PASSPORT_INTL": 7, "SSN": 4, "UAE_ID": 7, "NATIONAL_ID": 6, "DATE_DMY": 2, "DATE_LONG": 4,
    "DATE_ISO": 4, "PLATE_UK": 2, "MEDICAL_LICENSE": 7, "US_BANK_NUMBER": 8, "US_DRIVER_LICENSE": 6,
}
# Class of the first character of every match: most places are settled by it, before borders and what
# stands in front are looked at.
_FIRST = {
    "IBAN": "[A-Z]", "PHONE_INTL_PLUS": r"\+", "PHONE_LOCAL": r"[(\d]", "CREDIT_CARD_EXTENDED": r"\d",
    "PASSPORT_US": "[A-Z]", "PASSPORT_UK": "[0-9]", "PASSPORT_INTL": "[A-Z]", "SSN": r"\d", "UAE_ID": "7",
    "NATIONAL_ID": "[A-Z]", "IPV4": r"\d", "IPV6": "[0-9a-fA-F]", "URL_WITH_SCHEME": "h", "URL_WWW": "w",
    "DATE_DMY": r"\d", "DATE_LONG": r"\d", "DATE_ISO": r"\d", "PLATE_UK": "[A-Z]", "PLATE_US": "[A-Z0-9]",
    "VIN": "[A-HJ-NPR-Z0-9]", "MEDICAL_LICENSE": "[A-Za-z]", "US_BANK_NUMBER": "[0-9]",
    "US_DRIVER_LICENSE": "[A-Z]", "NAME_AFTER_LABEL": "[NCMP]",
}


def _build() -> tuple[SpanRule, ...]:
    rules = [
        SpanRule(
            entity, rule, regex, pct,
            label=ENTITY_LABELS[entity],
            context=CONTEXT.get(entity, ()),
            needs=_NEEDS.get(rule, ()),
            digits=_DIGITS.get(rule, 0),
            first=_FIRST.get(rule, ""),
            enabled=entity not in OFF_BY_DEFAULT,
        )
        for entity, rule, pct, regex in _PATTERNS
    ]
    rules.append(
        SpanRule(
            "PERSON", "NAME_AFTER_LABEL", _NAME_AFTER_LABEL, 50,
            label=ENTITY_LABELS["PERSON"], context=CONTEXT["PERSON"], needs=(":",), first=_FIRST["NAME_AFTER_LABEL"], group=1,
        )
    )
    return tuple(rules)


PII_RULES = _build()
GAZETTEER_PCT = 85


def select_rules(rules=PII_RULES, entities=None) -> tuple[SpanRule, ...]:
    """Prune rules before a plan exists (FLT-2): by entity, else the enabled ones."""
    if entities is None:
        return tuple(r for r in rules if r.enabled)
    wanted = set(entities)
    return tuple(r for r in rules if r.entity in wanted)
