"""Rules for credentials in source code."""

from __future__ import annotations

from .model import SpanRule
from .pii import IPV4

# --- fixed values: (label, rule, score in hundredths, literals in every match,
# --- masked group, characters after that group, pattern, description)
_Q = r"['\"]"
_PATTERNS = (
    ("AWS_ACCESS_KEY", "AWS_ACCESS_KEY", 99, ("AKIA",), 0, 0,
     r"\bAKIA[0-9A-Z]{16}\b", "AWS access key id"),
    ("RSA_PRIVATE_KEY", "RSA_PRIVATE_KEY", 99, ("-----BEGIN RSA PRIVATE KEY-----",), 0, 0,
     r"-----BEGIN RSA PRIVATE KEY-----.+?-----END RSA PRIVATE KEY-----", "RSA private key block"),
    ("PRIVATE_KEY", "PRIVATE_KEY", 99, ("PRIVATE KEY-----",), 0, 0,
     r"-----BEGIN (?:EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----.+?-----END [A-Z ]*PRIVATE KEY-----",
     "Private key block"),
    ("CERTIFICATE", "CERTIFICATE", 95, ("-----BEGIN CERTIFICATE-----",), 0, 0,
     r"-----BEGIN CERTIFICATE-----.+?-----END CERTIFICATE-----", "Certificate block"),
    ("AZURE_SECRET", "AZURE_SECRET", 90, (), 1, 1,
     rf"(?i)azure\w*secret\s*[=:]\s*{_Q}([^'\"]{{8,}}){_Q}", "Azure client secret"),
    ("GITHUB_TOKEN", "GITHUB_TOKEN", 98, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), 0, 0,
     r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", "GitHub token"),
    ("GITLAB_TOKEN", "GITLAB_TOKEN", 98, ("glpat-",), 0, 0,
     r"\bglpat-[\w-]{20,}", "GitLab token"),
    ("SLACK_TOKEN", "SLACK_TOKEN", 97, ("xox",), 0, 0,
     r"\bxox[baprs]-[\w-]{10,}", "Slack token"),
    ("STRIPE_KEY", "STRIPE_KEY", 98, ("k_live_", "k_test_"), 0, 0,
     r"\b[sp]k_(?:live|test)_[A-Za-z0-9]{16,}", "Stripe key"),
    ("API_KEY", "API_KEY_SK", 95, ("sk-",), 0, 0,
     r"\bsk-(?!ant-)(?:proj-)?[A-Za-z0-9]{20,}", "API key with sk- prefix"),
    ("API_KEY", "API_KEY_SK_ANT", 96, ("sk-ant-",), 0, 0,
     r"\bsk-ant-[\w-]{20,}", "API key with sk-ant- prefix"),
    ("SENDGRID_KEY", "SENDGRID_KEY", 98, ("SG.",), 0, 0,
     r"\bSG\.[\w-]{10,}\.[\w-]{20,}", "SendGrid key"),
    ("TWILIO_KEY", "TWILIO_KEY", 90, ("SK", "AC"), 0, 0,
     r"\b(?:SK|AC)[0-9a-f]{32}\b", "Twilio key"),
    ("MAILCHIMP_KEY", "MAILCHIMP_KEY", 95, ("-us",), 0, 0,
     r"\b[0-9a-f]{32}-us\d{1,2}\b", "Mailchimp key"),
    ("MAPBOX_TOKEN", "MAPBOX_TOKEN", 95, ("k.eyJ",), 0, 0,
     r"\b[ps]k\.eyJ[\w-]+\.[\w-]+", "Mapbox token"),
    ("JWT_TOKEN", "JWT_TOKEN", 95, ("eyJ",), 0, 0,
     r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", "JSON web token"),
    ("TOKEN", "TOKEN_BEARER", 85, (), 1, 0,
     r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{20,}=*)", "Bearer token"),
    ("TOKEN", "TOKEN_ASSIGNED", 80, (), 1, 1,
     rf"(?i)\b\w*token\s*[=:]\s*{_Q}([^'\"]{{16,}}){_Q}", "Assigned token"),
    ("PASSWORD", "PASSWORD", 80, (), 1, 1,
     rf"(?i)\b\w*(?:password|passwd|pwd)\s*[=:]\s*{_Q}([^'\"]{{4,}}){_Q}", "Hardcoded password"),
    ("SECRET", "SECRET", 78, (), 1, 1,
     rf"(?i)\b\w*secret(?:_?key)?\s*[=:]\s*{_Q}([^'\"]{{4,}}){_Q}", "Hardcoded secret"),
    ("CONNECTION_STRING", "CONNECTION_STRING", 97, ("://",), 0, 0,
     r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|mssql)://[^\s'\":@/]*:[^\s'\"]+@[^\s'\"]+",
     "Connection string with credentials"),
    ("SSH_PUBLIC_KEY", "SSH_PUBLIC_KEY", 95, ("ssh-rsa", "ssh-ed25519"), 0, 0,
     r"\bssh-(?:rsa|ed25519)\s+[A-Za-z0-9+/=]{20,}", "SSH public key"),
    ("WEBHOOK_URL", "WEBHOOK_SLACK", 97, ("https://hooks.slack.com/services/",), 0, 0,
     r"https://hooks\.slack\.com/services/[\w/]+", "Slack webhook URL"),
    ("WEBHOOK_URL", "WEBHOOK_DISCORD", 97, ("/api/webhooks/",), 0, 0,
     r"https://discord(?:app)?\.com/api/webhooks/\d+/[\w-]+", "Discord webhook URL"),
    ("IP_ADDRESS", "IP_IN_CODE", 75, (".",), 1, 1,
     rf"(?i)\b\w*(?:host|server|binding|addr|ip)\w*\s*[=:]\s*{_Q}({IPV4}){_Q}", "IP address in code"),
)
# --- end of fixed values

# Literals, case aside, of which every match contains one.
_NEEDS_FOLDED = {
    "AZURE_SECRET": ("azure",),
    "TOKEN_BEARER": ("bearer",),
    "TOKEN_ASSIGNED": ("token",),
    "PASSWORD": ("password", "passwd", "pwd"),
    "SECRET": ("secret",),
    "IP_IN_CODE": ("host", "server", "binding", "addr", "ip"),
}

SECRET_RULES = tuple(
    SpanRule(label, rule, regex, pct, label=label, needs=needs, group=group, tail=tail,
             needs_folded=_NEEDS_FOLDED.get(rule, ()), description=description)
    for label, rule, pct, needs, group, tail, regex, description in _PATTERNS
)
