from .model import FLAGS, SEVERITY_RANK, CodeRule, SpanRule
from .pii import (
    CONTEXT, DOCUMENT_ENTITIES, ENTITY_LABELS, GAZETTEER_PCT, LOCATION_DENYLIST,
    NAME_DENYLIST, PII_RULES, SEPARATORS, STRUCTURAL_IDS, select_rules,
)
from .secrets import SECRET_RULES
from .vulnerabilities import (
    BLOCKING, CODE_KINDS, DOCUMENT_KINDS, EXTERNAL_ADVICE, MINOR, VULNERABILITY_RULES,
)
