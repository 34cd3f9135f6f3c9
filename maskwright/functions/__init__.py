from .spans import FINDING, FINDINGS, find_spans, resolve_overlaps, rule_findings, splice
from .text import (
    extension, is_blank, kind_label, let, line_count, line_text, newline_count, percent,
    placeholder, remembered, snippet, split_lines, strip, title_case, word_count,
)
