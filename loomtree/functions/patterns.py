"""Patterns and word lists of the annotation format, in the syntax that both Java and RE2 read.

White space and word characters are spelled out, as the two engines' own classes cover ASCII only.
"""

from __future__ import annotations

# The format's white space (Unicode), line separators, headers, attributes, markers and types.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
OTHER_BREAKS = r"\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
FILE_LINE_BREAK = r"\r\n|[\n\r]"
HEADER = rf"(?s)^[{SPACE}]*@[{SPACE}]*(-+)[{SPACE}]+(.*?)[{SPACE}]*$"
ATTRIBUTE = rf'([\p{{L}}\p{{N}}_]+)=("[^"]*"|\[[^\]]*\]|[^{SPACE}]+)'
CUTOFF = rf"<!--[{SPACE}]*cutoff[{SPACE}]*-->"
CUTOFF_LITERAL = "<!-- cutoff -->"
NODE_TYPES = [
    "generic", "definition", "theorem", "lemma", "proposition", "corollary", "remark", "exercise", "example", "proof", "axiom",
]
PROVEABLE_TYPES = ["corollary", "lemma", "proposition", "theorem"]
SEMANTIC_TYPES = [t for t in NODE_TYPES if t != "generic"]
COMMENT = r"(?s)<!--.*?-->"
HEADER_LINE = rf"(?m)^[{SPACE}]*@[{SPACE}]*-+[{SPACE}]+.*$"
MATH_BLOCK = r"(?s)\$\$.*?\$\$"
MATH_INLINE = r"\$[^$\n]*?\$"
CONTENT_TOKEN = r"[a-z0-9]{3,}"
ROOT_ID, ROOT_TITLE = "__doc_root__", "Document Root"
