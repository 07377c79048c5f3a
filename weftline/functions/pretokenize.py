"""Pretokenizers: a text column as an array of pieces, by Spark's own regular expressions.

A pretokenizer is a name or a tuple of stages (pattern, behaviour); each stage
splits every piece of the one before.  Behaviours: ``matches`` keeps the matches
alone, ``isolated`` the matches and the gaps, ``removed`` the gaps,
``with_previous`` and ``with_next`` join a match to the gap before or after it.
Null stays null; an empty text has no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2F800}-\x{2FA1F}"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"

# Published patterns, whole: those of GPT-2, and of the cl100k and o200k vocabularies with the variants that public models use.
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CL100K = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[\p{L}]+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_VOYAGE = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[\p{L}]+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_QWEN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?[\p{L}\p{M}]+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
_O200K = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?"
    r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
_DEEPSEEK = r"[!-/:-@\[-`{-~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"

NAMED: dict[str, tuple[tuple[str, str], ...]] = {
    "gpt2": ((_GPT2, "matches"),),
    "cl100k": ((_CL100K, "matches"),),
    "o200k": ((_O200K, "matches"),),
    "voyage": ((_VOYAGE, "matches"),),
    "smollm": ((r"\p{N}", "isolated"), (_GPT2, "matches")),
    "deepseek": (
        (r"\p{N}{1,3}", "isolated"), ("[一-龥぀-ゟ゠-ヿ]+", "isolated"),
        (_DEEPSEEK, "isolated"),
    ),
    "qwen": ((_QWEN, "matches"),),
    "bert": ((rf"[{_CJK}]|[{_PUNCT}]|[^\s{_PUNCT}{_CJK}]+", "matches"),),
    "whitespace_split": ((r"\S+", "matches"),),
    "whitespace": ((r"\w+|[^\w\s]+", "matches"),),
    "digits": ((r"\p{N}", "isolated"),),
    "digit_runs": ((r"\p{N}+", "isolated"),),
    "punctuation": ((rf"[{_PUNCT}]", "isolated"),),
    "units": (("▁*[^▁]+|▁+", "matches"),),
}

#: The same patterns as public model files spell them.
KNOWN = frozenset(
    f"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\\r\\n\\p{{L}}\\p{{N}}]?{letters}+|{digits}| ?[^\\s{rest}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+(?!\\S)|\\s+"
    for letters, rest in ((r"\p{L}", r"\p{L}\p{N}"), (r"[\p{L}\p{M}]", r"\p{L}\p{M}\p{N}")) for digits in (r"\p{N}", r"\p{N}{1,3}")
) | {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def java(pattern: str, behaviour: str) -> str:
    gap = f"(?:(?!{pattern}).)"
    body = {"matches": pattern, "isolated": f"(?:{pattern})|{gap}+", "removed": f"{gap}+", "with_previous": f"{gap}*(?:{pattern})|{gap}+", "with_next": f"(?:{pattern}){gap}*|{gap}+"}[behaviour]
    return ("(?U)" if behaviour == "matches" else "(?Us)") + body


def stages(pretokenizer: str | tuple | None) -> tuple[tuple[str, str], ...]:
    if pretokenizer is None:
        return ()
    return NAMED[pretokenizer] if isinstance(pretokenizer, str) else tuple((p, b) for p, b in pretokenizer)


def _split(pattern: str):
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def pieces(c: Column, pretokenizer: str | tuple | None) -> Column:
    """The pieces of a text column; without a pretokenizer the whole text is one."""
    own = stages(pretokenizer)
    if not own:
        return F.when(c.isNotNull(), F.filter(F.array(c), lambda x: x != ""))
    out = _split(java(*own[0]))(c)
    for stage in own[1:]:
        out = F.flatten(F.transform(out, _split(java(*stage))))
    return out


def splitter(pretokenizer: str | tuple | None) -> Callable[[str], list[str]]:
    """The same pieces of a text outside Spark."""
    import regex

    def python(stage: tuple[str, str]):
        pattern = java(*stage).replace("(?U)", "").replace("(?Us)", "(?s)")
        return regex.compile(regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), pattern))

    own = [python(s) for s in stages(pretokenizer)]
    if len(own) == 1:
        return own[0].findall

    def run(text: str) -> list[str]:
        parts = [text] if text else []
        for p in own:
            parts = [x for part in parts for x in p.findall(part)]
        return parts

    return run
