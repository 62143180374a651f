"""Regular expressions, in the form Java's engine needs.

The expected results are those of an RE2-style engine: ASCII word boundaries,
``\\s`` without vertical tab, ``$`` only at the very end and ``.`` that stops at
``\\n`` alone.  Java differs on each, hence the explicit classes, ``\\z`` and the
``(?d)`` prefix.
"""

from __future__ import annotations

WS = r"[\t\n\f\r ]"
NOT_WS = r"[^\t\n\f\r ]"
WORD_START = r"(?<![0-9A-Za-z_])"
WORD_END = r"(?![0-9A-Za-z_])"
# Fixed value: Unicode white space, as trimmed around log lines.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Redaction patterns and markers, in the order they apply.
# The look-aheads only reject a position before the look-behind is tried.  A mail address
# can only begin where its run of characters begins, or where the last match ended; looking
# nowhere else keeps a long run without "@" from costing its length squared.
REDACTIONS: tuple[tuple[str, str, str], ...] = (
    (
        "email",
        r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
        "[email]",
    ),
    ("ipv4", r"(?=\d)" + WORD_START + r"(?:\d{1,3}\.){3}\d{1,3}" + WORD_END, "[ip]"),
    (
        "ipv6",
        r"(?=[0-9a-fA-F])" + WORD_START + r"(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}" + WORD_END,
        "[ip]",
    ),
    ("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[jwt]"),
    ("bearer", rf"(?iu)Bearer{WS}+[A-Za-z0-9_\-\.~+/=]+", "Bearer [token]"),
    (
        "stripe_key",
        "(?=[spr])" + WORD_START + r"(sk|pk|rk)_(test|live)_[A-Za-z0-9]{16,}" + WORD_END,
        "[api_key]",
    ),
    (
        "generic_api_key",
        rf"(?iu)(api[_\-]?key[\"']?{WS}*[:=]{WS}*[\"']?)([A-Za-z0-9_\-]{{16,}})",
        "$1[api_key]",
    ),
)

# A literal, or a shape, every match of a redaction pattern holds.
REDACTION_LITERALS: dict[str, tuple[str, ...]] = {
    "email": ("@",),
    "jwt": ("eyJ",),
    "stripe_key": ("_test_", "_live_"),
}
REDACTION_SHAPES: dict[str, str] = {
    "ipv4": r"\d\.\d",
    "ipv6": r"[0-9a-fA-F]:[0-9a-fA-F]",
}

# Shapes of stack traces.
PY_MARKER = "Traceback (most recent call last):"
PY_FRAME = rf'(?d)^{WS}*File "([^"]+)", line (\d+), in (.+)\z'
# Possessive, so that a long dotted name does not recurse.
PY_EXCEPTION = rf"(?d)^([A-Za-z_]\w*+(?:\.[A-Za-z_]\w*+)*+):{WS}*(.*)\z"
JAVA_HEADER = (
    rf'(?d)^(?:Exception in thread "[^"]+"{WS}+)?'
    rf"([\w$\.]+(?:Exception|Error|Throwable))(?::{WS}*(.*))?\z"
)
JAVA_FRAME = rf"(?d)^{WS}+at{WS}+(?:[\w./@$\-]+/)?([\w$\.]+)\(([^:)]*)(?::(\d+))?\)\z"
GO_HEADER = rf"(?d)^(panic|fatal error):{WS}*(.+)\z"
GO_FUNC = r"(?d)^([\w./\-]+\.[\w\-]+)\(.*\)\z"
GO_FILE = rf"(?d)^{WS}+([^:\t\n\f\r ]+\.go):(\d+)(?:{WS}+.*)?\z"
NODE_HEADER = rf"(?d)^(\w*Error):{WS}*(.*)\z"
NODE_FRAME = rf"(?d)^{WS}+at{WS}+({NOT_WS}.*?){WS}+\(([^):]+):(\d+):(\d+)\)\z"
NODE_ANONYMOUS = rf"(?d)^{WS}+at{WS}+([^():]+):(\d+):(\d+)\z"
RUBY_HEADER = rf"(?d)^([^:]+):(\d+):in `([^']+)':{WS}*(.*?){WS}*\(([\w:]+)\)\z"
RUBY_FRAME = rf"(?d)^{WS}+from{WS}+([^:]+):(\d+):in `([^']+)'\z"

# Fixed value: a Python function definition line.
PY_DEF = rf"(?d)^([ \t]*)(?:async{WS}+)?def{WS}+([A-Za-z_]\w*){WS}*\("

RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T\d{1,2}:\d{2}:\d{2}([.,]\d+)?(Z|[+\-]\d{2}:\d{2})\z"
)
