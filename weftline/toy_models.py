"""Small models with known answers: for tests, examples and the registered queries."""

from __future__ import annotations

from .functions.normalize import BERT_UNCASED
from .spec import AddedToken, ModelSpec, Template

_BASE = tuple((b, bytes([b])) for b in range(256))

#: Pairs in order of rank, of common letter sequences; each is a letter, or made by an earlier pair.
PAIRS = (
    "t h|i n|e r|a n|o n|r e|h e|e n|o u|s t|e d|n d|a t|e s|th e|i t|o r|in g|an d|t i|l y|i s|a r|h a|w h|e a|th at|b le|l e|"
    "n t|c h|e u|au x|d e|l a|l o|m i|i o|ti on|e l|u n|v er|ei t|s ch|i e|d er|g e|b er|l l|r r|a s|o s|c o|p a|q u|qu e|m ent|e t|en t|er e|ou s|f or|th er"
).split("|")


def letters() -> ModelSpec:
    """Byte-level merges over lower-case letters, after GPT-2's pretokenizer; 256 bytes and the pairs that can be made."""
    vocab, ids, merges = list(_BASE), {bytes([b]): b for b in range(256)}, []
    for pair in PAIRS:
        a, b = (x.encode() for x in pair.split())
        if a in ids and b in ids and a + b not in ids:
            ids[a + b] = len(vocab)
            vocab.append((len(vocab), a + b))
            merges.append((ids[a], ids[b], ids[a + b]))
    return ModelSpec(encoder="bpe", vocab=tuple(vocab), merges=tuple(merges), pretokenizer="gpt2")


def words() -> ModelSpec:
    """WordPiece over common beginnings and endings, with BERT's normalizer and template: [PAD] 0, [UNK] 1, [CLS] 2, [SEP] 3."""
    own = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
    starts = "the of and a in to that er th re an on st he en ou at ed es it or is ti ar ha wh ea ble nt ch de la lo un le el ver sch ge ie der co pa que . , ! ? : ; ( ) \" ' - | = + % $ # * & @ /".split()
    ends = "the th er in an on re he en ou st at ed es it or ing ly is ti ea ha nd sh ble nt tion ch a b c d e f g h i j k l m n o p q r s t u v w x y z 0 1 2 3 4 5 6 7 8 9".split()
    alphabet = [chr(c) for c in range(97, 123)] + [str(d) for d in range(10)]
    tokens = list(dict.fromkeys([*own, *starts, *alphabet, *("##" + e for e in ends)]))
    return ModelSpec(
        encoder="wordpiece", vocab=tuple((i, t.encode()) for i, t in enumerate(tokens)), normalizer=BERT_UNCASED, pretokenizer="bert", unk_id=1, pad_token_id=0,
        template=Template.bert(2, 3), added=(),
    )


def bpe_bytes(*extra: tuple[bytes, bytes], **options) -> ModelSpec:
    """256 bytes and merges of the given pairs."""
    vocab, ids, merges = list(_BASE), {bytes([b]): b for b in range(256)}, []
    for a, b in extra:
        ids[a + b] = len(vocab)
        merges.append((ids[a], ids[b], ids[a + b]))
        vocab.append((ids[a + b], a + b))
    return ModelSpec(encoder="bpe", vocab=tuple(vocab), merges=tuple(merges), **options)


def with_end_of_text(spec: ModelSpec, content: str = "<|endoftext|>", **flags) -> ModelSpec:
    from dataclasses import replace

    i = max(k for k, _ in spec.vocab) + 1
    return replace(spec, added=(AddedToken(i, content, special=True, **flags),))


def pieces_unigram() -> ModelSpec:
    """Unigram over letters, common endings and ``▁``; [unk] 0."""
    from math import log

    table = [("<unk>", 0.0), ("▁", 0.02)] + [(c, 0.004) for c in "abcdefghijklmnopqrstuvwxyz.,"]
    table += [(x, 0.01) for x in "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic".split()]
    table += [("▁" + x, 0.015) for x in "the of and to in a is that for it as was with be by on not he his are this at from".split()]
    vocab = tuple((i, t.encode()) for i, (t, _) in enumerate(table))
    return ModelSpec(encoder="unigram", vocab=vocab, scores=tuple(log(s) if s else 0.0 for _, s in table), normalizer=(("lowercase",), ("metaspace", "always")), unk_id=0)


def charsmap(entries: dict[str, str]) -> bytes:
    """A precompiled map of one-byte keys: a double-array trie and the replacements."""
    from struct import pack

    units, texts = [0] * 1024, b""
    units[0] = 1 << 10  # the root's children are at 1 ^ byte
    for n, (key, to) in enumerate(entries.items()):
        (byte,) = key.encode()
        node, leaf = 1 ^ byte, 512 + 2 * n
        units[node] = byte | (1 << 8) | ((node ^ leaf) << 10)
        units[leaf] = (1 << 31) | len(texts)
        texts += to.encode() + b"\0"
    raw = pack(f"<{len(units)}I", *units)
    return pack("<I", len(raw)) + raw + texts
