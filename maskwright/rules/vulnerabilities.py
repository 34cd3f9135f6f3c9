"""Rules for risky code, and the file kinds the engine knows by extension."""

from __future__ import annotations

from .model import CodeRule

# --- fixed values: severities, patterns and report texts must equal the
# --- established ones, since titles and lines decide which findings are equal.
VULNERABILITY_RULES = (
    CodeRule(
        "SEC-RULE-001", "SQL Injection Risk",
        "String formatting or concatenation used to build SQL query.",
        "CRITICAL",
        r"(?i)(execute|cursor\.execute|query|raw)\s*\(\s*['\"].*?['\"].*?%|f['\"].*?SELECT|f['\"].*?INSERT|f['\"].*?UPDATE|f['\"].*?DELETE",
        "CWE-89: SQL Injection",
        "Use parameterized queries or an ORM instead of string formatting.",
        needs_folded=("execute", "query", "raw", "select", "insert", "update", "delete"),
    ),
    CodeRule(
        "SEC-RULE-002", "Command Injection Risk",
        "User-controlled input may be passed to a shell command.",
        "CRITICAL",
        r"(?:os\.system|subprocess\.call|subprocess\.run|popen)\s*\(\s*(?:f['\"]|['\"].*?\+|.*?format)",
        "CWE-78: OS Command Injection",
        "Avoid shell=True. Use subprocess with a list of arguments and validate all input.",
        needs=("os.system", "subprocess.call", "subprocess.run", "popen"),
    ),
    CodeRule(
        "SEC-RULE-003", "LDAP Injection Risk",
        "Unescaped input used in LDAP filter construction.",
        "HIGH",
        r"(?i)ldap.*search.*filter.*[\+%]|ldap.*filter.*format",
        "CWE-90: LDAP Injection",
        "Use an LDAP library that supports parameterized filters and escape all user input.",
        needs_folded=("ldap",),
    ),
    CodeRule(
        "SEC-RULE-004", "XPath Injection Risk",
        "Unescaped input used in XPath expression.",
        "HIGH",
        r"(?i)xpath.*[\+%].*input|find\(.*f['\"]",
        "CWE-643: XPath Injection",
        "Sanitize all user input before including in XPath expressions.",
        needs_folded=("xpath", "find("),
    ),
    CodeRule(
        "SEC-RULE-005", "Weak Hashing Algorithm",
        "MD5 or SHA1 used — both are cryptographically broken.",
        "HIGH",
        r"(?i)hashlib\.(md5|sha1)\s*\(|(?:md5|sha1)\s*\(",
        "CWE-327: Use of Broken Cryptographic Algorithm",
        "Use SHA-256 or stronger. For passwords, use bcrypt, scrypt, or argon2.",
        needs_folded=("md5", "sha1"),
    ),
    CodeRule(
        "SEC-RULE-006", "Hardcoded Salt or IV",
        "Static salt or initialization vector detected — weakens encryption.",
        "HIGH",
        r"(?i)(?:salt|iv|nonce)\s*=\s*['\"][^'\"]{4,}['\"]",
        "CWE-760: Predictable Salt",
        "Generate cryptographic salt/IV randomly using os.urandom() or secrets module.",
        needs_folded=("salt", "iv", "nonce"),
    ),
    CodeRule(
        "SEC-RULE-007", "Insecure Random Number Generator",
        "random module used for security-sensitive context.",
        "MEDIUM",
        r"(?i)import random|random\.(?:random|randint|choice|seed)\s*\(",
        "CWE-338: Use of Cryptographically Weak PRNG",
        "Use the secrets module for security-sensitive random values.",
        needs_folded=("random",),
    ),
    CodeRule(
        "SEC-RULE-008", "Unsafe Deserialization (pickle)",
        "pickle.loads() on untrusted data allows arbitrary code execution.",
        "CRITICAL",
        r"pickle\.loads?\s*\(",
        "CWE-502: Deserialization of Untrusted Data",
        "Never unpickle data from untrusted sources. Use JSON or protobuf instead.",
        needs=("pickle.load",),
    ),
    CodeRule(
        "SEC-RULE-009", "Unsafe YAML Load",
        "yaml.load() without Loader can execute arbitrary Python.",
        "CRITICAL",
        r"yaml\.load\s*\(\s*(?!.*Loader=yaml\.SafeLoader)",
        "CWE-502: Deserialization of Untrusted Data",
        "Use yaml.safe_load() or yaml.load(data, Loader=yaml.SafeLoader) instead.",
        needs=("yaml.load",),
    ),
    CodeRule(
        "SEC-RULE-010", "Unsafe eval() Usage",
        "eval() on dynamic or user-controlled input is a code injection vector.",
        "CRITICAL",
        r"\beval\s*\(\s*(?![\'\"])",
        "CWE-95: Improper Neutralization of Directives in Eval",
        "Avoid eval() entirely. Use ast.literal_eval() for safe expression parsing.",
        needs=("eval",),
    ),
    CodeRule(
        "SEC-RULE-011", "TLS Certificate Verification Disabled",
        "SSL/TLS certificate verification is turned off — enables MITM attacks.",
        "CRITICAL",
        r"(?i)verify\s*=\s*False|ssl_verify\s*=\s*False|check_hostname\s*=\s*False",
        "CWE-295: Improper Certificate Validation",
        "Never disable certificate verification in production. Fix the certificate instead.",
        needs_folded=("verify", "check_hostname"),
    ),
    CodeRule(
        "SEC-RULE-012", "Hardcoded HTTP (Non-HTTPS) URL",
        "Plain HTTP URL detected — traffic is unencrypted.",
        "MEDIUM",
        r"['\"]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)[^'\"]{4,}['\"]",
        "CWE-319: Cleartext Transmission of Sensitive Information",
        "Use HTTPS for all external endpoints.",
        needs=("http://",),
    ),
    CodeRule(
        "SEC-RULE-013", "Binding to All Interfaces (0.0.0.0)",
        "Server binding to 0.0.0.0 exposes it on all network interfaces.",
        "MEDIUM",
        r"['\"]0\.0\.0\.0['\"]",
        "CWE-605: Multiple Binds to the Same Port",
        "Bind to 127.0.0.1 in development. Use a reverse proxy in production.",
        needs=("0.0.0.0",),
    ),
    CodeRule(
        "SEC-RULE-014", "Hardcoded JWT Secret",
        "JWT signing secret is hardcoded in source — can be extracted.",
        "CRITICAL",
        r"(?i)(?:jwt|token).*secret\s*=\s*['\"][^'\"]{4,}['\"]",
        "CWE-321: Use of Hard-coded Cryptographic Key",
        "Load JWT secrets from environment variables or a secrets manager.",
        needs_folded=("secret",),
    ),
    CodeRule(
        "SEC-RULE-015", "Weak Session Secret",
        "Session secret key appears short or predictable.",
        "HIGH",
        r"(?i)(?:secret[_-]?key|session[_-]?secret)\s*=\s*['\"][^'\"]{4,20}['\"]",
        "CWE-331: Insufficient Entropy",
        "Use a cryptographically random secret of at least 32 bytes via secrets.token_hex(32).",
        needs_folded=("secret",),
    ),
    CodeRule(
        "SEC-RULE-016", "Path Traversal Risk",
        "User input used in file path without sanitization.",
        "HIGH",
        r"(?i)open\s*\(\s*(?:request|input|user|param|data)|os\.path\.join\s*\([^)]*(?:request|input|user)",
        "CWE-22: Path Traversal",
        "Validate and sanitize file paths. Use pathlib and ensure the resolved path is within the expected directory.",
        needs_folded=("open", "os.path.join"),
    ),
    CodeRule(
        "SEC-RULE-017", "Insecure Temporary File",
        "tempfile.mktemp() is insecure — race condition between creation and use.",
        "MEDIUM",
        r"tempfile\.mktemp\s*\(",
        "CWE-377: Insecure Temporary File",
        "Use tempfile.mkstemp() or tempfile.NamedTemporaryFile() instead.",
        needs=("tempfile.mktemp",),
    ),
    CodeRule(
        "SEC-RULE-018", "Debug Mode Enabled",
        "Debug mode left on — exposes stack traces and internal info.",
        "HIGH",
        r"(?i)(?:debug\s*=\s*True|app\.run\s*\([^)]*debug\s*=\s*True)",
        "CWE-94: Improper Control of Generation of Code",
        "Disable debug mode in production. Use environment variables to control this.",
        needs_folded=("debug",),
    ),
    CodeRule(
        "SEC-RULE-019", "Sensitive Data in Log Statement",
        "Password, token, or secret may be logged in plaintext.",
        "HIGH",
        r"(?i)(?:log|print|logger)\s*.*(?:password|passwd|secret|token|api_key|credential)",
        "CWE-532: Insertion of Sensitive Information into Log File",
        "Never log sensitive values. Mask or omit them from log output.",
        needs_folded=("password", "passwd", "secret", "token", "api_key", "credential"),
    ),
    CodeRule(
        "SEC-RULE-020", "Unpinned Dependency",
        "Dependency without pinned version — vulnerable to supply chain attacks.",
        "LOW",
        r"^(?!#)[\w\-]+\s*(?:>=|<=|~=|!=|>|<)\s*[\d.]+\s*$|^(?!#)[\w\-]+\s*$",
        "CWE-1357: Reliance on Insufficiently Trustworthy Component",
        "Pin all dependencies to exact versions (==) in production.",
    ),
)

BLOCKING = ("CRITICAL", "HIGH")
MINOR = ("LOW", "INFO")

DOCUMENT_KINDS = {
    "txt": "Plain Text",
    "md": "Markdown",
    "docx": "Word Document",
    "xlsx": "Excel Spreadsheet",
    "csv": "CSV File",
    "pdf": "PDF Document",
    "eml": "Email File",
    "html": "HTML File",
    "json": "JSON File",
    "xml": "XML File",
}

CODE_KINDS = {
    "py": "Python",
    "js": "JavaScript",
    "ts": "TypeScript",
    "jsx": "React JSX",
    "tsx": "React TSX",
    "go": "Go",
    "rb": "Ruby",
    "rs": "Rust",
    "java": "Java",
    "kt": "Kotlin",
    "swift": "Swift",
    "cs": "C#",
    "cpp": "C++",
    "c": "C",
    "php": "PHP",
    "sh": "Shell",
    "bash": "Bash",
    "zsh": "Zsh",
    "yaml": "YAML",
    "yml": "YAML",
    "toml": "TOML",
    "env": "Dotenv",
    "tf": "Terraform",
    "json": "JSON",
    "xml": "XML",
    "sql": "SQL",
    "dockerfile": "Dockerfile",
}

EXTERNAL_ADVICE = "See https://bandit.readthedocs.io for remediation guidance."
# --- end of fixed values
