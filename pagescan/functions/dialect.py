"""Python ``re`` patterns in the JVM's dialect.

Python's classes are Unicode-aware, Java's are not, and ``.`` knows only one line
end in Python.  The two engines otherwise share the syntax used by page rules.
"""

import re

SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
_BEFORE, _AFTER = f"(?<![{WORD}])", f"(?![{WORD}])"
_CLASSES = {"s": (SPACE, f"[{SPACE}]"), "S": ("", f"[^{SPACE}]"),
            "w": (WORD, f"[{WORD}]"), "W": ("", f"[^{WORD}]"),
            "d": (r"\p{Nd}", r"\p{Nd}"), "D": (r"\P{Nd}", r"\P{Nd}"),
            "Z": ("Z", r"\z")}
_WORD_START = re.compile(r"[A-Za-z]+(?![A-Za-z?*+{])")
_FLAGS = {"i": "iu", "s": "s", "m": "m"}
_ANYTHING = r"\[(?:\\s\\S|\\S\\s|\\w\\W|\\W\\w|\\d\\D|\\D\\d)\]"
_TOKEN = re.compile(_ANYTHING + r"|\\.|\(\?P<|\(\?P=(\w+)\)|\{,(\d+)\}|\{\d+,?\d*\}|&&|.", re.S)


def to_java(pattern: str, flags: str = "") -> str:
    """The Java pattern that matches what ``re.compile(pattern, flags)`` matches.

    ValueError where Java has no equal form.
    """
    out, in_class, first, skip = [], False, False, 0
    for token in _TOKEN.finditer(pattern):
        if token.start() < skip:
            continue
        t = token.group(0)
        escaped = t[1] if t[0] == "\\" else ""
        opened = False
        if re.fullmatch(_ANYTHING, t) and not in_class:
            out.append("(?s:.)")
        elif in_class and escaped in ("W", "S"):
            raise ValueError(f"negated class inside a class: {pattern}")
        elif escaped == "b" and not in_class:
            word = _WORD_START.match(pattern, token.end())
            if word:
                # The word first, then the look back: the JVM searches for literals much faster.
                out.append(f"{word.group(0)}(?<![{WORD}]{word.group(0)})")
                skip = word.end()
            else:
                out.append(f"(?:(?<=[{WORD}]){_AFTER}|{_BEFORE}(?=[{WORD}]))")
        elif escaped == "B" and not in_class:
            out.append(f"(?:(?<=[{WORD}])(?=[{WORD}])|{_BEFORE}{_AFTER})")
        elif escaped in _CLASSES:
            out.append(_CLASSES[escaped][0 if in_class else 1])
        elif escaped:
            out.append(t)
        elif in_class:
            if t == "]" and not first:
                in_class = False
                out.append(t)
            elif t == "^" and first:
                opened = True
                out.append(t)
            else:
                out.append("".join("\\" + c if c in "[]&" else c for c in t))
        elif t == "[":
            in_class = opened = True
            out.append(t)
        elif t == "(?P<":
            out.append("(?<")
        elif token.group(1):
            out.append(rf"\k<{token.group(1)}>")
        elif token.group(2):
            out.append(f"{{0,{token.group(2)}}}")
        elif t == "{":
            out.append(r"\{")
        else:
            out.append(t)
        first = opened
    inline = "".join(_FLAGS[f] for f in dict.fromkeys(flags.lower()) if f in _FLAGS)
    return f"(?d{inline})" + "".join(out)


def to_re2(pattern: str, flags: str = "") -> str:
    """The same pattern for an RE2 engine; only ``\\b`` is left as RE2's ASCII one."""
    java = to_java(re.sub(r"(?<!\\)\\b", "\x00", pattern))
    body = java[len("(?d)"):].replace("\x00", r"\b").replace(r"\s\x1c", r"\s\x0b\x1c")
    inline = "".join(f for f in dict.fromkeys(flags.lower()) if f in _FLAGS)
    return f"(?{inline})" + body if inline else body
