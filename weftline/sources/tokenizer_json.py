"""Models from the public ``tokenizer.json`` form.

What the form says is followed: flags of the BERT normalizer, the single and pair
templates, prefix spaces, split behaviours.  What can't be followed (dropout,
unknown node types) is an error, never left out in silence.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

from ..functions.pretokenize import NAMED
from ..spec import AddedToken, ModelSpec, Template
from .storage import fetched, is_remote


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(token: str, byte_level: bool) -> bytes:
    if not byte_level:
        return token.encode()
    own = byte_alphabet()
    return bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()


def _nodes(node: dict | None, inner: str) -> list[dict]:
    if not node:
        return []
    return [x for part in node[inner] for x in _nodes(part, inner)] if node["type"] == "Sequence" else [node]


def _pattern(p: dict | str) -> str:
    return p if isinstance(p, str) else p["Regex"] if "Regex" in p else re.escape(p["String"])


def normalizer_steps(node: dict | None) -> tuple[tuple, ...]:
    steps: list[tuple] = []
    for n in _nodes(node, "normalizers"):
        kind = n["type"]
        if kind == "BertNormalizer":
            if n.get("clean_text", True):
                steps.append(("clean",))
            if n.get("handle_chinese_chars", True):
                steps.append(("space_cjk",))
            strip = n.get("strip_accents")
            if n.get("lowercase", True) if strip is None else strip:
                steps.append(("strip_accents",))
            if n.get("lowercase", True):
                steps.append(("lowercase",))
        elif kind in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
            steps.append((kind.lower(),))
        elif kind == "StripAccents":
            steps.append(("drop_marks",))
        elif kind == "Replace":
            p = n["pattern"]
            steps.append(("replace", p["String"], n["content"]) if "String" in p else ("replace_regex", p["Regex"], n["content"]))
        elif kind == "Prepend":
            steps.append(("prepend", n["prepend"]))
        elif kind == "Strip":
            steps.append(("strip", n.get("strip_left", True), n.get("strip_right", True)))
        elif kind == "Precompiled":
            steps.append(("precompiled", base64.b64decode(n["precompiled_charsmap"])))
        else:
            raise ValueError(f"normalizer {kind} isn't supported")
    return tuple(steps)


_BEHAVIOURS = {"Isolated": "isolated", "Removed": "removed", "MergedWithPrevious": "with_previous", "MergedWithNext": "with_next"}


def pretokenizer_of(node: dict | None) -> tuple[tuple | None, tuple[tuple, ...], bool, bool]:
    """(stages, normalizer steps that come from it, whether byte-level, whether a space is put first)."""
    stages: list[tuple[str, str]] = []
    steps: list[tuple] = []
    byte_level = space = False
    for n in _nodes(node, "pretokenizers"):
        kind = n["type"]
        if kind == "ByteLevel":
            byte_level, space = True, space or n.get("add_prefix_space", False)
            if n.get("use_regex", True):
                stages += NAMED["gpt2"]
        elif kind == "Metaspace":
            scheme = n.get("prepend_scheme") or ("always" if n.get("add_prefix_space", True) else "never")
            steps.append(("metaspace", {"always": "unless_led", "first": "first", "never": "never"}[scheme]))
            if n.get("split", True):
                stages.append(("▁[^▁]*|[^▁]+", "matches"))
        elif kind == "BertPreTokenizer":
            stages += NAMED["bert"]
        elif kind == "Whitespace":
            stages += NAMED["whitespace"]
        elif kind == "WhitespaceSplit":
            stages += NAMED["whitespace_split"]
        elif kind == "Digits":
            stages += NAMED["digits" if n.get("individual_digits") else "digit_runs"]
        elif kind == "Punctuation":
            stages.append((NAMED["punctuation"][0][0], _BEHAVIOURS[n.get("behavior", "Isolated")]))
        elif kind == "Split":
            behaviour = _BEHAVIOURS.get(n.get("behavior", "Isolated"))
            if behaviour is None:
                raise ValueError(f"split behaviour {n['behavior']} isn't supported")
            if n.get("invert"):
                behaviour = {"removed": "matches", "isolated": "isolated"}.get(behaviour)
                if behaviour is None:
                    raise ValueError("an inverted split that merges isn't supported")
            stages.append((_pattern(n["pattern"]), behaviour))
        else:
            raise ValueError(f"pretokenizer {kind} isn't supported")
    return tuple(stages) or None, tuple(steps), byte_level, space


def template_of(node: dict | None, ids: dict[str, int]) -> Template:
    found = Template()
    if not node:
        return found
    for n in node["processors"] if node["type"] == "Sequence" else [node]:
        kind = n["type"]
        if kind == "ByteLevel":
            continue
        if kind in ("BertProcessing", "RobertaProcessing"):
            cls, sep = n["cls"][1], n["sep"][1]
            found = Template((cls,), (sep,), (cls,), (sep,), (sep,) if kind == "RobertaProcessing" else (), (sep,))
            continue
        if found != Template():
            raise ValueError("two post-processors that add tokens aren't supported")
        if kind != "TemplateProcessing":
            raise ValueError(f"post-processor {kind} isn't supported")
        special = {k: tuple(v["ids"]) for k, v in (n.get("special_tokens") or {}).items()}

        def split(parts, special=special):
            out, at = [[], [], []], 0
            for p in parts:
                if "Sequence" in p:
                    at += 1
                else:
                    out[at] += special.get(p["SpecialToken"]["id"], (ids.get(p["SpecialToken"]["id"], -1),))
            return [tuple(x) for x in out], [p["SpecialToken"]["type_id"] if "SpecialToken" in p else None for p in parts]

        (before, after, _), _ = split(n["single"])
        if not n.get("pair"):  # a pair has then the specials of two single texts
            found = Template(before, after, before, after, before, after)
            continue
        (a, middle, end), types = split(n["pair"])
        # of the specials in the middle, those with the second text's type go with it
        own = [t for t in types[len(a) + 1 : len(a) + 1 + len(middle)] if t is not None]
        cut = sum(t == 0 for t in own)
        found = Template(before, after, a, middle[:cut], middle[cut:], end)
    return found


def is_topological(merges: list[tuple[int, int, int]]) -> bool:
    return all(m > a and m > b for a, b, m in merges)


def from_json_str(text: str, pretokenizer: str | tuple | None = None, encoder: str | None = None) -> ModelSpec:
    """A model from the text of the form; the two options go before what it says."""
    j = json.loads(text)
    model = j["model"]
    vocab, merges = model["vocab"], model.get("merges") or []
    kind = model.get("type") or ("Unigram" if isinstance(vocab, list) else "BPE" if merges else "WordPiece")
    stages, more_steps, byte_level, space = pretokenizer_of(j.get("pre_tokenizer"))
    steps = normalizer_steps(j.get("normalizer")) + more_steps
    byte_level |= any(n["type"] == "ByteLevel" for n in _nodes(j.get("decoder"), "decoders")) and kind == "BPE"
    if model.get("dropout"):
        raise ValueError("dropout isn't supported")
    scores: tuple[float, ...] = ()
    if kind == "Unigram":
        own, pairs = "unigram", [(i, t.encode()) for i, (t, _) in enumerate(vocab)]
        scores, unk = tuple(float(s) for _, s in vocab), model.get("unk_id")
        ids = {t: i for i, (t, _) in enumerate(vocab)}
    else:
        ids = vocab
        own = "wordpiece" if kind == "WordPiece" else "bpe" if byte_level else "sp_bpe"
        pairs = sorted((i, token_bytes(t, byte_level and kind == "BPE")) for t, i in vocab.items())
        unk = ids.get(model["unk_token"]) if model.get("unk_token") else None
    rules = []
    prefix, end = model.get("continuing_subword_prefix") or "", model.get("end_of_word_suffix") or ""
    for m in merges:
        a, b = m.split(" ", 1) if isinstance(m, str) else m
        joined = a + (b.removeprefix(prefix) if prefix and kind == "BPE" else b)
        if a in ids and b in ids and joined in ids:
            rules.append((ids[a], ids[b], ids[joined]))
    added = []
    for t in j.get("added_tokens") or []:
        i = ids.get(t["content"], t["id"])
        added.append(AddedToken(i, t["content"], t.get("special", False), t.get("lstrip", False), t.get("rstrip", False), t.get("normalized", False), t.get("single_word", False)))
    pad = (j.get("padding") or {}).get("pad_id")
    every = {**ids, **{t.content: t.id for t in added}}
    return ModelSpec(
        encoder=encoder or own, vocab=tuple(pairs), merges=tuple(rules), scores=scores, normalizer=steps, pretokenizer=pretokenizer if pretokenizer is not None else stages, added=tuple(added),
        template=template_of(j.get("post_processor"), every), unk_id=unk, byte_fallback=bool(model.get("byte_fallback")), ignore_merges=bool(model.get("ignore_merges")), fuse_unk=bool(model.get("fuse_unk")),
        continuing_prefix=prefix or "##", word_end=end, max_chars=model.get("max_input_chars_per_word") or 100, add_prefix_space=space,
        pad_token_id=pad if pad is not None else next((every[p] for p in ("[PAD]", "<pad>", "<|pad|>") if p in every), None),
    )


def from_json(path: str | Path, pretokenizer: str | tuple | None = None, encoder: str | None = None) -> ModelSpec:
    """The model of a file; a path with a scheme is one of a file system of Hadoop's."""
    if is_remote(path):
        with fetched(str(path)) as own:
            return from_json(own, pretokenizer, encoder)
    return from_json_str(Path(path).read_text(encoding="utf-8"), pretokenizer, encoder)


def from_ranks(path: str | Path, pretokenizer: str | tuple = "gpt2") -> ModelSpec:
    """A byte-level model from a file of (base64 token, rank) lines.

    The rank of a merge is that of what it makes; its parts are those into which the
    merges before it take the token apart.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}

    def parts(token: bytes) -> list[bytes]:
        out = [token[k : k + 1] for k in range(len(token))]
        own = ranks[token]
        while len(out) > 2:
            best = min((ranks.get(a + b, own), k) for k, (a, b) in enumerate(zip(out, out[1:])))
            if best[0] >= own:
                break
            out[best[1] : best[1] + 2] = [out[best[1]] + out[best[1] + 1]]
        return out

    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            two = parts(token)
            if len(two) == 2:
                merges.append((ranks[two[0]], ranks[two[1]], rank))
    return ModelSpec(encoder="bpe", vocab=tuple(sorted((i, t) for t, i in ranks.items())), merges=tuple(merges), pretokenizer=pretokenizer)
