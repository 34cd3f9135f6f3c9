"""Finding, masking and restoring sensitive values in tables and streams."""

from .operators.filters import settle
from .operators.mask import explode_vault, find_pii, find_secrets, mask_code, mask_documents
from .operators.recognizers import gazetteer_findings, user_recognizer, with_gazetteer
from .operators.restore import restore, restore_nested, unresolved
from .operators.scan import explode_findings, scan, scan_report, scan_secrets, scan_vulnerabilities
from .operators.sessions import append_vault, build_vault, mask_sessions, session_values
from .sources.readers import read_code, read_documents
from .sources.vaults import open_vault, seal_vault
from .streaming.streams import SessionVault, mask_stream, restore_stream
