"""Normalizers: a tuple of steps, as a native Spark expression where that is exact, else as one Arrow function.

Steps are (name, arguments...): ``clean``, ``lowercase``, ``strip_accents``,
``space_cjk``, ``nfc`` ``nfd`` ``nfkc`` ``nfkd``, ``replace`` (needle, text), ``replace_regex``
(pattern, text), ``prepend`` (text), ``strip`` (left, right), ``metaspace`` (``always``,
``unless_led`` or ``first``), ``sentencepiece``, ``sentencepiece_lowercase``,
``precompiled`` (charsmap), ``precompiled_metaspace`` (charsmap, white space split) and
``punct_pad`` (charsmap).  Null stays null; an empty text stays empty but where a
step puts something before any text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..workers import in_slices, reach
from .charsmap import Charsmap

MARK = "▁"
BERT_CASED = (("clean",),)
BERT_UNCASED = (("nfd",), ("drop_marks",), ("clean",), ("lowercase",))
#: Steps that Spark's own functions express exactly.
NATIVE = {"clean", "lowercase", "space_cjk", "replace", "replace_regex", "prepend", "strip", "metaspace", "drop_marks", "collapse"}

_DROPPED = {"Cc", "Cf", "Cn", "Co"}
_CJK = "一-鿿㐀-䶿豈-﫿\U00020000-\U0002a6df\U0002a700-\U0002ceaf\U0002f800-\U0002fa1f"
_CJK_RUN = re.compile(f"([{_CJK}])")
_PUNCTUATION = re.compile(r"([!-/:-@\[-`{-~])")
_SPACES = re.compile(r"\s+")
_JAVA_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2F800}-\x{2FA1F}"


class _Each(dict):
    """A table for ``str.translate``, by a function of a character that is asked once for each; it gives None for what is dropped."""

    def __init__(self, to: Callable[[str], str | None]):
        self.to = to

    def __missing__(self, code: int) -> str | None:
        self[code] = out = self.to(chr(code))
        return out


def _cleaned(c: str) -> str | None:
    if c in "\t\n\r":
        return " "
    kind = unicodedata.category(c)
    return None if kind in _DROPPED or c == "�" else " " if kind == "Zs" else c


def _unmarked(c: str) -> str | None:
    return None if unicodedata.category(c) == "Mn" else c


def _without_control(c: str, format_to: str) -> str | None:
    if c in "\t\n\r\f":
        return " "
    kind = unicodedata.category(c)
    return None if kind == "Cc" else format_to if kind == "Cf" or c == "�" else c


_CLEANED, _UNMARKED = _Each(_cleaned), _Each(_unmarked)
_SPACED, _BARE = _Each(lambda c: _without_control(c, " ")), _Each(lambda c: _unmarked(c) and _without_control(c, ""))


def _clean(text: str) -> str:
    return text if text.isascii() and text.isprintable() else text.translate(_CLEANED)


def _drop_marks(text: str) -> str:
    return text if text.isascii() else text.translate(_UNMARKED)


def _lower(text: str) -> str:
    """Each character by itself: a final sigma is like any other."""
    return text.replace("Σ", "σ").lower()


def _metaspace(text: str, scheme: str, first: bool) -> str:
    if not text:
        return text
    led = text[0] in (" ", MARK)
    put = {"always": True, "unless_led": not led, "first": first and not led, "never": False}[scheme]
    return (MARK if put else "") + text.replace(" ", MARK)


def _sentencepiece(text: str) -> str:
    return MARK + MARK.join(unicodedata.normalize("NFKC", text).translate(_SPACED).split())


def _sentencepiece_lowercase(text: str) -> str:
    return _lower(MARK + MARK.join(unicodedata.normalize("NFKD", text).translate(_BARE).split()))


def _precompiled_metaspace(text: str, charsmap: Charsmap, split: bool) -> str:
    if not text:
        return text
    text = charsmap.apply(text)
    if split:
        return MARK + _SPACES.sub(" ", text).strip().replace(" ", MARK)
    led = text.startswith((" ", MARK))
    return ("" if led else MARK) + re.sub(" +", MARK, text)


def _punct_pad(text: str, charsmap: Charsmap | None) -> str:
    if not text:
        return text
    text = (charsmap.apply(text) if charsmap else text).strip()
    if not text:
        return ""
    put = "" if text.startswith(MARK) else MARK
    return put + _SPACES.sub(" ", _PUNCTUATION.sub(r" \1 ", text)).strip().replace(" ", MARK)


def normalizer(steps: tuple[tuple, ...]) -> Callable[[str, bool], str]:
    """The steps as a function of a text and whether it begins the document."""
    done: list[Callable[[str, bool], str]] = []
    for name, *args in steps:
        if name in ("nfc", "nfd", "nfkc", "nfkd"):
            done.append(lambda t, _, form=name.upper(): t if t.isascii() else unicodedata.normalize(form, t))
        elif name == "clean":
            done.append(lambda t, _: _clean(t))
        elif name == "lowercase":
            done.append(lambda t, _: _lower(t))
        elif name == "drop_marks":
            done.append(lambda t, _: _drop_marks(t))
        elif name == "strip_accents":
            done.append(lambda t, _: t if t.isascii() else _drop_marks(unicodedata.normalize("NFD", t)))
        elif name == "space_cjk":
            done.append(lambda t, _: _CJK_RUN.sub(r" \1 ", t))
        elif name == "replace":
            done.append(lambda t, _, a=args: t.replace(a[0], a[1]) if a[0] else t)
        elif name == "replace_regex":
            done.append(lambda t, _, p=re.compile(args[0]), r=args[1]: p.sub(lambda m: r, t))
        elif name == "prepend":
            done.append(lambda t, _, a=args: a[0] + t if t else t)
        elif name == "strip":
            done.append(lambda t, _, a=args: t.strip() if all(a) else t.lstrip() if a[0] else t.rstrip() if a[1] else t)
        elif name == "collapse":
            done.append(lambda t, _: _SPACES.sub(" ", t).strip())
        elif name == "metaspace":
            done.append(lambda t, first, a=args: _metaspace(t, a[0], first))
        elif name == "sentencepiece":
            done.append(lambda t, _: _sentencepiece(t))
        elif name == "sentencepiece_lowercase":
            done.append(lambda t, _: _sentencepiece_lowercase(t))
        elif name == "precompiled":
            done.append(lambda t, _, m=Charsmap(args[0]): m.apply(t))
        elif name == "precompiled_metaspace":
            done.append(lambda t, _, m=Charsmap(args[0]), s=args[1]: _precompiled_metaspace(t, m, s))
        elif name == "punct_pad":
            done.append(lambda t, _, m=Charsmap(args[0]) if args[0] else None: _punct_pad(t, m))
        else:
            raise ValueError(f"no normalizer step {name!r}")

    def run(text: str, first: bool = True) -> str:
        for f in done:
            text = f(text, first)
        return text

    return run


def is_native(steps: tuple[tuple, ...]) -> bool:
    return all(s[0] in NATIVE for s in steps)


def _native(c: Column, name: str, *args) -> Column:
    if name == "clean":
        return F.regexp_replace(F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Cn}\p{Co}\x{FFFD}&&[^\t\n\r]]", ""), r"[\t\n\r\p{Zs}]", " ")
    if name == "lowercase":
        return F.lower(F.translate(c, "Σ", "σ"))
    if name == "drop_marks":
        return F.regexp_replace(c, r"\p{Mn}", "")
    if name == "space_cjk":
        return F.regexp_replace(c, f"([{_JAVA_CJK}])", " $1 ")
    if name == "replace":
        return F.replace(c, F.lit(args[0]), F.lit(args[1])) if args[0] else c
    if name == "replace_regex":
        return F.regexp_replace(c, "(?U)" + args[0], args[1].replace("\\", "\\\\").replace("$", "\\$"))
    if name == "prepend":
        return F.when(c == "", c).otherwise(F.concat(F.lit(args[0]), c))
    if name == "strip":
        both = "|".join(p for p, on in zip((r"^\s+", r"\s+$"), args) if on)
        return F.regexp_replace(c, "(?U)" + both, "") if both else c
    if name == "collapse":
        return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    if name == "metaspace":
        marked = F.replace(c, F.lit(" "), F.lit(MARK))
        led = c.startswith(" ") | c.startswith(MARK)
        if args[0] == "never":
            return marked
        put = F.concat(F.lit(MARK), marked)
        return F.when(c == "", c).otherwise(put if args[0] == "always" else F.when(led, marked).otherwise(put))
    raise ValueError(f"no native step {name!r}")


def normalize(c: Column, steps: tuple[tuple, ...]) -> Column:
    """A text column, normalized as whole texts."""
    if is_native(steps):
        for name, *args in steps:
            c = _native(c, name, *args)
        return c
    spark = SparkSession.active()
    reach(spark)

    from ..operators import chunks

    if chunks.local_steps(steps):

        @in_slices("string")
        def by_chunks(texts: pa.Array) -> pa.Array:
            def make():
                first, later = normalizer(steps), normalizer(chunks.later(steps))
                return chunks.Texts(lambda t, leads, _: [first(t, True) if leads else later(t, False)])

            parts, bounds = chunks.kept(("normalize", steps), make).texts(texts)
            values = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            rows = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), "")
            return pc.if_else(texts.is_valid(), rows, None) if texts.null_count else rows

        return by_chunks(c)

    @in_slices("string")
    def run(texts: pa.Array) -> pa.Array:
        f = normalizer(steps)
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return run(c)


def find_and_replace(c: Column, needle: str, text: str) -> Column:
    """Every occurrence of ``needle`` replaced; an empty needle changes nothing."""
    return _native(c, "replace", needle, text)
