"""Queries on a whole public vocabulary and on whole documents, with SQL that encodes by itself.

The vocabulary is that of byte_bpe_50k.tiktoken in the folder ``WEFTLINE_TOKENIZERS`` (``/opt/tokenizers``).
The SQL takes pieces apart into bytes and joins, in each round of a recursive query, the
neighbours of each piece whose joint token has the least rank.
"""

from __future__ import annotations

import os
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toy_models
from .functions import normalize, pretokenize, sql
from .operators import diff
from .operators.tokenizer import Tokenizer
from .plans import dedup
from .queries import _CJK, _W, BYTES, LETTERS, WORDS, _gpt2, _marked, _matches, documents, query, spelled, table
from .sources.documents import scratch
from .sources.tokenizer_json import from_ranks
from .spec import AddedToken, ModelSpec, Padding

FOLDER = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{FOLDER}/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def public(path: str = VOCABULARY) -> ModelSpec:
    return from_ranks(path)


# SQL

_RANKS = f"ranks as (select hex(from_base64(tok)) as h, r from read_csv('{VOCABULARY}', delim = ' ', header = false, quote = '', columns = {{'tok': 'varchar', 'r': 'integer'}}))"


def _words(pieces: str, source: str = "documents", key: str = "doc_id") -> str:
    """CTEs: pieces (key, pos, piece) and words (w, hs, ids), with the tokens of each distinct piece as hexadecimal bytes and as ids."""
    return rf"""{_RANKS},
cut as (select {key}, {pieces} as p from {source}), pieces as (select {key}, unnest(p) as piece, generate_subscripts(p, 1) as pos from cut),
s(w, t, step) as (select distinct piece, regexp_extract_all(hex(encode(piece)), '..'), 0 from pieces union all
select w, list_concat(list_append(t[:i - 1], t[i] || t[i + 1]), t[i + 2:]), step + 1 from
(select s.w, any_value(s.t) as t, any_value(s.step) as step, arg_min(u.i, (r.r, u.i)) as i from s, unnest(range(1, len(s.t))) as u(i), ranks r where r.h = s.t[u.i] || s.t[u.i + 1] group by s.w)),
last as (select w, arg_max(t, step) as hs from s group by w), one as (select w, unnest(hs) as h, generate_subscripts(hs, 1) as k from last),
words as (select w, list(h order by k) as hs, list(r order by k) as ids from one join ranks using (h) group by w)"""


_GPT2 = _gpt2("text")
_DOCS = _words(_GPT2)
_IDS = "each as (select doc_id, flatten(list(ids order by pos)) as ids, sum(len(ids)) as n from pieces join words on w = piece group by doc_id), done as (select d.doc_id, d.text, coalesce(ids, []) as ids, cast(coalesce(n, 0) as bigint) as n from documents d left join each using (doc_id))"
_SPELLED = "md5(array_to_string(ids, ' '))"


def hexed(text: str) -> str:
    return f"regexp_extract_all(hex(encode({text})), '..')"


def bytes_of(text: str) -> str:
    """The bytes of a text as a list of numbers."""
    return f"list_transform({hexed(text)}, lambda x: cast('0x' || x as integer))"


def digest(ids) -> F.Column:
    return F.md5(spelled(ids))


# encoding and counting


@query("d1_public_ids", f"with recursive {_DOCS}, {_IDS} select doc_id, n as n_ids, {_SPELLED} as digest from done")
def d1_public(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", Tokenizer(public()).encode_ids(F.col("text")).alias("ids"))
    return own.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), digest(F.col("ids")).alias("digest"))


@query("v12_count_tokens", f"with recursive {_DOCS}, {_IDS} select doc_id, n as n_tokens from done")
def v12(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Tokenizer(public()).count_tokens(F.col("text")).cast("bigint").alias("n_tokens"))


@query("v15_exceeds", f"with recursive {_DOCS}, {_IDS} select doc_id, cast(sign(n - 300) as integer) as result, n > 300 as more from done")
def v15(spark: SparkSession, d: str) -> DataFrame:
    t = Tokenizer(public())
    return table(spark, d, "documents").select("doc_id", t.compare_count(F.col("text"), 300).alias("result"), t.exceeds(F.col("text"), 300).alias("more"))


@query("tokens_by_quality", f"with recursive {_DOCS}, {_IDS} select quality, count(*) as texts, cast(sum(n) as bigint) as tokens from done join labels using (doc_id) group by quality")
def tokens_by_quality(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", Tokenizer(public()).count_tokens(F.col("text")).alias("n"))
    return n.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.count("*").alias("texts"), F.sum("n").alias("tokens"))


@query("plan_by_distinct_pieces", f"with recursive {_DOCS}, {_IDS} select doc_id, n as n_tokens from done")
def plan_by_distinct_pieces(spark: SparkSession, d: str) -> DataFrame:
    return dedup.count_by_key(table(spark, d, "documents"), public())


@query("token_frequency", f"with recursive {_DOCS} select id, count(*) as n from (select unnest(ids) as id from pieces join words on w = piece) group by id")
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return dedup.token_counts(table(spark, d, "documents"), public())


@query("d3_offsets", f"""with recursive {_DOCS},
t as (select doc_id, pos, unnest(hs) as h, generate_subscripts(hs, 1) as k from pieces join words on w = piece), places as (select doc_id, pos, k, length(h) // 2 as size, sum(length(h) // 2) over (partition by doc_id order by pos, k) as stop from t),
o as (select doc_id, count(*) as n, string_agg(cast(stop - size as bigint) || '-' || cast(stop as bigint), ' ' order by pos, k) as o from places group by doc_id)
select doc_id, cast(coalesce(n, 0) as integer) as n_offsets, md5(coalesce(o, '')) as digest from documents left join o using (doc_id)""")
def d3(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", Tokenizer(public()).encode_with_offsets(F.col("text"), False)["offsets"].alias("o"))
    return own.select("doc_id", F.size("o").alias("n_offsets"), F.md5(F.array_join(F.transform("o", lambda x: F.concat_ws("-", x["start"], x["end"])), " ")).alias("digest"))


@query("d8_flat_batch", f"with recursive {_DOCS}, {_IDS} select doc_id, {_SPELLED} as digest, n, cast(coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from done")
def d8(spark: SparkSession, d: str) -> DataFrame:
    return Tokenizer(public()).encode_batch_flat(table(spark, d, "documents"), "doc_id").select("doc_id", digest(F.col("ids")).alias("digest"), "n", "start")


@query("d10_token_stream", f"with recursive {_words(_GPT2, 'conversations', 'conv_id, turn')}, each as (select conv_id, turn, flatten(list(ids order by pos)) as ids from pieces join words on w = piece group by conv_id, turn) select conv_id, turn, cast(generate_subscripts(ids, 1) - 1 as integer) as pos, unnest(ids) as id from each")
def d10(spark: SparkSession, d: str) -> DataFrame:
    return Tokenizer(public()).stream_tokens(table(spark, d, "conversations").select("conv_id", "turn", "text"))


@query("d11_byte_stream", f"select conv_id, turn, cast(generate_subscripts(b, 1) - 1 as integer) as pos, unnest(b) as id from (select conv_id, turn, {bytes_of('text')} as b from conversations)")
def d11(spark: SparkSession, d: str) -> DataFrame:
    return Tokenizer(BYTES).stream_bytes(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("content")))


@query("e6_encode_bytes", f"select doc_id, md5(array_to_string({bytes_of('text')}, ' ')) as digest from documents")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", digest(Tokenizer(BYTES).encode_bytes(F.col("text").cast("binary"))).alias("digest"))


_TURNS = "t as (select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as answer from conversations)"


@query("d4_encode_pair", f"""with {_TURNS}, n as (select *, strlen(text) as a, strlen(answer) as b from t where answer is not null),
m as (select *, case when a + b <= 61 then a when least(a, b) * 2 <= 61 then case when a >= b then 61 - b else a end else 30 end as x, case when a + b <= 61 then b when least(a, b) * 2 <= 61 then case when a >= b then b else 61 - a end else 31 end as y from n)
select conv_id, turn, md5(array_to_string(list_concat([1], list_concat(list_concat({bytes_of('text')}[:x], [2]), list_concat({bytes_of('answer')}[:y], [2]))), ' ')) as ids, cast(x + 2 as bigint) as n_first, cast(y + 1 as bigint) as n_second from m""")
def d4(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("*", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer")).where("answer is not null")
    e = turns.select("conv_id", "turn", Tokenizer(BYTES.with_truncation(max_length=64)).encode_pair(F.col("text"), F.col("answer")).alias("e"))
    return e.select("conv_id", "turn", digest(F.col("e.ids")).alias("ids"), F.size(F.filter("e.type_ids", lambda x: x == 0)).cast("bigint").alias("n_first"), F.size(F.filter("e.type_ids", lambda x: x == 1)).cast("bigint").alias("n_second"))


@query("d12_single_or_pair", f"with {_TURNS} select conv_id, turn, md5(array_to_string(case when answer is null then list_concat([1], list_concat({bytes_of('text')}, [2])) else list_concat([1], list_concat(list_concat({bytes_of('text')}, [2]), list_concat({bytes_of('answer')}, [2]))) end, ' ')) as ids from t")
def d12(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").select("*", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))
    return turns.select("conv_id", "turn", digest(Tokenizer(BYTES).encode_any(F.col("text"), F.col("answer"))["ids"]).alias("ids"))


@query("d7_encode_batch", f"with n as (select conv_id, turn, list_concat([1], list_concat({bytes_of('text')}, [2])) as ids from conversations), m as (select cast(ceil(max(len(ids)) / 8.0) * 8 as bigint) as m from n) select conv_id, turn, len(ids) as n_real, md5(array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda k: 0)), ' ')) as ids from n, m")
def d7(spark: SparkSession, d: str) -> DataFrame:
    e = Tokenizer(BYTES.with_padding(Padding(pad_to_multiple_of=8))).encode_batch(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return e.select("conv_id", "turn", F.size(F.filter("encoding.attention_mask", lambda x: x == 1)).cast("bigint").alias("n_real"), digest(F.col("encoding.ids")).alias("ids"))


# added tokens with their flags: a token of a byte model takes white space on both sides with it, or is a word of its own


def _added(content: str, **flags) -> Tokenizer:
    return Tokenizer(ModelSpec(encoder="bpe", vocab=BYTES.vocab, pretokenizer="gpt2", added=(AddedToken(256, content, special=True, **flags),)))


def _added_query(name: str, sql: str, content: str, **flags) -> None:
    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        ids = table(spark, d, "documents").select("doc_id", _added(content, **flags).encode_ids(F.col("text")).alias("ids"))
        others = F.array_remove("ids", 256)
        return ids.select("doc_id", (F.size("ids") - F.size(others)).cast("bigint").alias("n_added"), digest(others).alias("others"))


_added_query("d5_added_tokens", f"select doc_id, len(regexp_extract_all(text, 'License')) as n_added, md5(array_to_string({bytes_of('''replace(text, 'License', '')''')}, ' ')) as others from documents", "License")
_added_query("d5_added_tokens_stripping", f"select doc_id, len(regexp_extract_all(text, 'the')) as n_added, md5(array_to_string({bytes_of(f'''regexp_replace(text, '[{_W}]*the[{_W}]*', '', 'g')''')}, ' ')) as others from documents", "the", lstrip=True, rstrip=True)
_added_query("d5_added_tokens_of_one_word", rf"""with r as (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as r from documents)
select doc_id, len(list_filter(r, lambda x: x = 'the')) as n_added, md5(array_to_string({bytes_of('''array_to_string(list_filter(r, lambda x: x <> 'the'), '')''')}, ' ')) as others from r""", "the", single_word=True)

# models whose pieces are put together from characters or scores

_SP = ModelSpec(encoder="sp_bpe", vocab=(*LETTERS.vocab, (LETTERS.vocab_size, "▁".encode())), merges=LETTERS.merges, normalizer=(("metaspace", "always"),), byte_fallback=True)
_TOKEN = {i: t.decode("latin-1") for i, t in LETTERS.vocab}
_MERGES = ", ".join(f"({k}, '{_TOKEN[a]}', '{_TOKEN[b]}')" for k, (a, b, _) in enumerate(LETTERS.merges))
_OWN = ", ".join([*(f"('{_TOKEN[m]}', '{m}')" for _, _, m in LETTERS.merges), f"('▁', '{LETTERS.vocab_size}')"])


@query("e1_bpe_ids", rf"""with recursive merges(r, a, b) as (values {_MERGES}), own(tok, id) as (values {_OWN}), p as (select doc_id, {_GPT2} as p from documents), pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos from p),
s(w, r, x) as (select distinct piece, 0, regexp_replace(piece, '((?s).)', chr(1) || '\1' || chr(2), 'g') from pieces union all
select s.w, s.r + 1, replace(s.x, chr(1) || m.a || chr(2) || chr(1) || m.b || chr(2), chr(1) || m.a || m.b || chr(2)) from s join merges m on m.r = s.r),
t as (select w, unnest(l) as tok, generate_subscripts(l, 1) as k from (select w, regexp_extract_all(x, '(?s)\x01([^\x02]*)\x02', 1) as l from s where r = (select count(*) from merges))),
ids as (select w, string_agg(coalesce(id, array_to_string({bytes_of('t.tok')}, ' ')), ' ' order by k) as ids from t left join own on own.tok = t.tok and own.tok <> '▁' group by w),
done as (select doc_id, string_agg(ids, ' ' order by pos) as ids from pieces join ids on w = piece group by doc_id)
select doc_id, coalesce(ids, '') as ids from documents left join done using (doc_id)""")
def e1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spelled(Tokenizer(LETTERS).encode_ids(F.col("text"))).alias("ids"))


@query("e3_sp_bpe_ids", rf"""with recursive merges(r, a, b) as (values {_MERGES}), own(tok, id) as (values {_OWN}),
p as (select doc_id, case when text = '' then [] else regexp_extract_all('▁' || replace(text, ' ', '▁'), '▁*[^▁]+|▁+') end as p from documents), pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos from p),
s(w, r, x) as (select distinct piece, 0, regexp_replace(piece, '((?s).)', chr(1) || '\1' || chr(2), 'g') from pieces union all
select s.w, s.r + 1, replace(s.x, chr(1) || m.a || chr(2) || chr(1) || m.b || chr(2), chr(1) || m.a || m.b || chr(2)) from s join merges m on m.r = s.r),
t as (select w, unnest(l) as tok, generate_subscripts(l, 1) as k from (select w, regexp_extract_all(x, '(?s)\x01([^\x02]*)\x02', 1) as l from s where r = (select count(*) from merges))),
ids as (select w, string_agg(coalesce(id, array_to_string({bytes_of('tok')}, ' ')), ' ' order by k) as ids from t left join own using (tok) group by w),
done as (select doc_id, string_agg(ids, ' ' order by pos) as ids from pieces join ids on w = piece group by doc_id)
select doc_id, coalesce(ids, '') as ids from documents left join done using (doc_id)""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spelled(Tokenizer(_SP).raw_ids(F.col("text"))).alias("ids"))


documents("v4_metaspace_decode", lambda c: Tokenizer(_SP).decode(Tokenizer(_SP).raw_ids(c)), "replace(text, '▁', ' ')", "text")


_UNIGRAM = toy_models.pieces_unigram()
_SCORES = ", ".join(f"('{t.decode()}', {i}, {s!r})" for (i, t), s in zip(_UNIGRAM.vocab, _UNIGRAM.scores) if i)
_PENALTY = min(_UNIGRAM.scores) - 10.0
_LONGEST = max(len(t.decode()) for _, t in _UNIGRAM.vocab)


@query("e5_unigram_ids", rf"""with recursive scores(tok, id, score) as (values {_SCORES}), vocabulary as (select map(list(tok), list(struct_pack(id := id, score := cast(score as double)))) as m from scores),
p as (select doc_id, case when text = '' then [] else regexp_extract_all('▁' || replace(lower(text), ' ', '▁'), '▁*[^▁]+|▁+') end as p from documents), pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos from p),
words as (select distinct piece as w, length(piece) as n from pieces),
best(w, n, k, scores, size, ids) as (select w, n, 0, [0.0 :: double], [] :: bigint[], [] :: integer[] from words union all
select w, n, k + 1, list_append(scores, top.score), list_append(size, top.size), list_append(ids, top.id) from
(select b.*, list_aggregate(list_filter(list_transform(range(least(k + 1, {_LONGEST}), 0, -1), lambda z: struct_pack(score := scores[k + 2 - z] + coalesce(v.m[substr(w, k + 2 - z, z)].score, case when z = 1 then {_PENALTY!r} end), back := z, size := z, id := coalesce(v.m[substr(w, k + 2 - z, z)].id, 0))), lambda x: x.score is not null), 'max') as top from best b, vocabulary v where k < n)),
path(w, k, size, all_ids, ids) as (select w, n, size, ids, [] :: integer[] from best where k = n union all select w, k - size[k], size, all_ids, list_prepend(all_ids[k], ids) from path where k > 0),
found as (select w, ids from path where k = 0), flat as (select doc_id, flatten(list(ids order by pos)) as ids from pieces join found on w = piece group by doc_id)
select doc_id, coalesce(array_to_string(list_transform(list_filter(list_zip(ids, list_prepend(-1, ids[:-2])), lambda x: not (x[1] = 0 and x[2] = 0)), lambda x: x[1]), ' '), '') as ids from documents left join flat using (doc_id)""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spelled(Tokenizer(_UNIGRAM).raw_ids(F.col("text"))).alias("ids"))


_D3 = "|".join((r"[!-/:-@\[-`{-~][A-Za-z]+", r"[^\r\n\p{L}\p{P}\p{S}\x01]?[\p{L}\p{M}]+", r" ?[\p{P}\p{S}]+[\r\n]*", rf"[{_W}]*[\r\n]+", f"[{_W}]+", rf"[^{_W}\p{{L}}\p{{M}}\p{{P}}\p{{S}}\x01]+", r"\x01"))
_HAN = "一-龥぀-ゟ゠-ヿ"


@query("p6_deepseek_pieces", rf"""with a as (select doc_id, flatten(list_transform(regexp_extract_all(text, '\p{{N}}{{1,3}}|[^\p{{N}}]+'), lambda s: regexp_extract_all(s, '[{_HAN}]+|[^{_HAN}]+'))) as p from documents),
p as (select doc_id, flatten(list_transform(p, lambda s: {_matches(_marked('s', r' \t\p{Z}'), _D3)})) as p from a) select doc_id, cast(len(p) as integer) as n_pieces, md5(array_to_string(p, chr(2))) as digest from p""")
def p6(spark: SparkSession, d: str) -> DataFrame:
    from .operators import encode

    own = table(spark, d, "documents").select("doc_id", encode.split_text(F.col("text"), "deepseek").alias("p"))
    return own.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x02")).alias("digest"))


_STAGES = (("[aeiou]+", "with_previous"), (" ", "removed"), ("[0-9]", "isolated"), ("-", "with_next"))


@query("p9_custom_stages", r"""with a as (select doc_id, flatten(list_transform(regexp_extract_all(text, '(?s)[^aeiou]*[aeiou]+|[^aeiou]+'), lambda s: regexp_extract_all(s, '[^ ]+'))) as p from documents),
p as (select doc_id, flatten(list_transform(flatten(list_transform(p, lambda s: regexp_extract_all(s, '[0-9]|[^0-9]+'))), lambda s: regexp_extract_all(s, '-[^-]*|[^-]+'))) as p from a)
select doc_id, cast(len(p) as integer) as n_pieces, md5(array_to_string(p, chr(2))) as digest from p""")
def p9(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").select("doc_id", pretokenize.pieces(F.col("text"), _STAGES).alias("p"))
    return own.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x02")).alias("digest"))


# character maps

_MAP = toy_models.charsmap({"q": "kw", "E": "e", "!": " !", "\t": " "})
_MAPPED = "replace(replace(replace(replace(text, 'q', 'kw'), 'E', 'e'), '!', ' !'), chr(9), ' ')"
_PADDED = rf"regexp_replace(regexp_replace({_MAPPED}, '([!-/:-@\[-`{{-~])', ' \1 ', 'g'), '[{_W}]+', ' ', 'g')"
documents("n12_charsmap", lambda c: normalize.normalize(c, (("precompiled", _MAP),)), _MAPPED)
documents("n10_charsmap_metaspace", lambda c: normalize.normalize(c, (("precompiled_metaspace", _MAP, False),)), f"case when text = '' then '' else case when {_MAPPED}[1] in (' ', '▁') then '' else '▁' end || regexp_replace({_MAPPED}, ' +', '▁', 'g') end")
documents("n11_punct_pad", lambda c: normalize.normalize(c, (("punct_pad", _MAP),)), f"case when trim({_PADDED}, ' ') = '' then '' else '▁' || replace(trim({_PADDED}, ' '), ' ', '▁') end")

# decoding and vocabulary

documents("v1_public_round_trip", lambda c: Tokenizer(public()).decode(Tokenizer(public()).encode_ids(c)), "text", "text")
documents("v5_decode_bytes", lambda c: F.md5(Tokenizer(LETTERS).decode_bytes(Tokenizer(LETTERS).raw_ids(c))), "md5(text)")
documents("a11_token_strings", lambda c: F.md5(F.array_join(Tokenizer(BYTES).tokens(Tokenizer(BYTES).raw_ids(c)), "|")), f"md5(array_to_string(list_transform({bytes_of('text')}, lambda x: case when x < 128 then chr(x) else '�' end), '|'))")

_BERT = r"lower(strip_accents(regexp_replace(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), '[\p{Cc}\p{Cf}\p{Co}\x{FFFD}]', '', 'g'), '\p{Zs}', ' ', 'g')))"
_VOCAB = ", ".join(f"({i}, '" + t.decode().replace("'", "''") + "')" for i, t in WORDS.vocab)


_BERT_PIECES = rf"c as (select doc_id, regexp_extract_all({_BERT}, '[{_CJK}]|[!-/:-@\[-`{{-~\p{{P}}]|[^{_W}!-/:-@\[-`{{-~\p{{P}}{_CJK}]+') as p from documents), pieces as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as pos from c), words as (select distinct piece as w from pieces)"


@query("e4_wordpiece_ids", rf"""with recursive vocab(id, tok) as (values {_VOCAB}), {_BERT_PIECES},
s(w, p, ids) as (select w, 0, [] :: integer[] from words union all
select w, p, ids from (select s.w, s.p + length(v.tok) - case when s.p > 0 then 2 else 0 end as p, list_append(s.ids, v.id) as ids, row_number() over (partition by s.w order by length(v.tok) desc) as k
from s join vocab v on s.p < length(s.w) and v.tok = case when s.p > 0 then '##' else '' end || substr(s.w, s.p + 1, length(v.tok) - case when s.p > 0 then 2 else 0 end)) where k = 1),
whole as (select w, ids from s where p = length(w) and p <= 100), done as (select doc_id, string_agg(coalesce(array_to_string(ids, ' '), '1'), ' ' order by pos) as ids from pieces left join whole on w = piece group by doc_id)
select doc_id, '2' || coalesce(' ' || ids, '') || ' 3' as ids from documents left join done using (doc_id)""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", spelled(Tokenizer(WORDS).encode_ids(F.col("text"))).alias("ids"))


@query("v3_wordpiece_decode", rf"""with recursive vocab(id, tok) as (values {_VOCAB}), {_BERT_PIECES},
s(w, p) as (select w, 0 from words union all select w, p from (select s.w, s.p + length(v.tok) - case when s.p > 0 then 2 else 0 end as p, row_number() over (partition by s.w order by length(v.tok) desc) as k
from s join vocab v on s.p < length(s.w) and v.tok = case when s.p > 0 then '##' else '' end || substr(s.w, s.p + 1, length(v.tok) - case when s.p > 0 then 2 else 0 end)) where k = 1),
whole as (select w from s where p = length(w) and p <= 100), done as (select doc_id, string_agg(case when w is null then '[UNK]' else piece end, ' ' order by pos) as text from pieces left join whole on w = piece group by doc_id)
select doc_id, coalesce(done.text, '') as text from documents left join done using (doc_id)""")
def v3(spark: SparkSession, d: str) -> DataFrame:
    t = Tokenizer(WORDS)
    return table(spark, d, "documents").select("doc_id", t.decode(t.encode_ids(F.col("text"))).alias("text"))


@query("v7_id_to_token", f"with recursive {_DOCS}, f as (select id, count(*) as n from (select unnest(ids) as id from pieces join words on w = piece) group by id) select id, n, case when contains(t, '�') then null else t end as token_str from (select id, n, try(decode(from_hex(h))) as t from f join ranks on r = id)")
def v7(spark: SparkSession, d: str) -> DataFrame:
    own = Tokenizer(public()).id_to_token(dedup.token_counts(table(spark, d, "documents"), public()))
    return own.select("id", "n", F.when(~F.col("token_str").contains("�"), F.col("token_str")).alias("token_str"))


@query("v8_token_to_id", rf"""with {_RANKS}, w as (select distinct unnest(regexp_extract_all(text, ' ?\p{{L}}+')) as token from documents) select token, r as id from w left join ranks on h = hex(encode(token))""")
def v8(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\p{L}+"), F.lit(0))).alias("token")).distinct()
    return Tokenizer(public()).token_to_id(words)


@query("v9_vocabulary", f"with {_RANKS} select r as id, lower(h) as token, cast(length(h) // 2 as integer) as n_bytes from ranks")
def v9(spark: SparkSession, d: str) -> DataFrame:
    return Tokenizer(public()).vocab().select("id", F.lower(F.hex("token")).alias("token"), "n_bytes")


@query("e8_adjacent_ids", f"with recursive merges(a, b) as (values {', '.join(f'({a}, {b})' for a, b, _ in LETTERS.merges)}), b as (select {bytes_of('text')} as b from documents), n as (select unnest(b[:-2]) as a, unnest(b[2:]) as b from b) select n.a as left, n.b as right, count(*) as n, max(m.a) is null as valid from n left join merges m on m.a = n.a and m.b = n.b group by all")
def e8(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "documents").select(Tokenizer(BYTES).raw_ids(F.col("text")).alias("x"))
    pairs = ids.select(F.explode(F.arrays_zip(F.expr("slice(x, 1, greatest(size(x) - 1, 0))").alias("left"), F.expr("slice(x, 2, greatest(size(x) - 1, 0))").alias("right"))).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("n"))
    return Tokenizer(LETTERS).adjacent(pairs)


# comparison

_TH = toy_models.bpe_bytes((b"t", b"h"))


@query("v17_identical", "select count(*) as texts, count(*) filter (where not contains(text, 'th')) as passed, count(*) filter (where contains(text, 'th')) as failed, cast(sum(strlen(text)) as bigint) as tokens from documents")
def v17(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return diff.verify(table(spark, d, "documents"), text, Tokenizer(BYTES).raw_ids(text), Tokenizer(_TH).raw_ids(text))


@query("v18_first_difference", "select doc_id, case when contains(text, 'th') then cast(strlen(left(text, position('th' in text) - 1)) as integer) end as at from documents")
def v18(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", diff.first_difference(Tokenizer(BYTES).raw_ids(text), Tokenizer(_TH).raw_ids(text)).alias("at"))


@query("v16_diff", r"""with m as (select doc_id, text, regexp_extract_all(text, '(?:th)+') as m, string_split_regex(text, '(?:th)+') as g from documents),
r as (select doc_id, text, m, list_transform(range(1, least(len(m), 100) + 1), lambda k: cast(list_sum(list_transform(g[:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: strlen(x))), 0) as bigint)) as spots from m)
select doc_id, cast(strlen(text) as integer) as text_bytes, cast(len(m) as integer) as diff_count, cast(coalesce(list_sum(list_transform(m, lambda x: strlen(x))), 0) as integer) as diff_bytes,
md5(array_to_string(list_transform(range(1, len(spots) + 1), lambda k: spots[k] || ':' || m[k] || ':' || strlen(m[k]) || ':' || strlen(m[k]) // 2), ' ')) as regions from r""")
def v16(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    own = table(spark, d, "documents").select("doc_id", diff.diff(text, Tokenizer(BYTES).raw_ids(text), Tokenizer(_TH).raw_ids(text), BYTES, _TH).alias("d"))
    regions = F.array_join(F.transform("d.regions", lambda r: F.concat_ws(":", r["start"], r["text"], F.size(r["a"]), F.size(r["b"]))), " ")
    return own.select("doc_id", "d.text_bytes", "d.diff_count", "d.diff_bytes", F.md5(regions).alias("regions"))


# SQL functions and streams


@query("sql_functions", f"with recursive {_DOCS}, {_IDS} select doc_id, cast(n as integer) as n, {_SPELLED} as digest, text from done")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, public(), "wft")
    return spark.sql("select doc_id, wft_count(text) as n, md5(array_join(wft_encode_ids(text), ' ')) as digest, wft_decode(wft_encode_ids(text)) as text from {docs}", docs=table(spark, d, "documents"))


@query("sql_token_rows", f"""with recursive {_words(_GPT2, 'conversations', 'conv_id, turn')}, t as (select conv_id, turn, pos as piece_at, unnest(hs) as h, unnest(ids) as id, generate_subscripts(hs, 1) as k from pieces join words on w = piece),
o as (select *, length(h) // 2 as size, sum(length(h) // 2) over (partition by conv_id, turn order by piece_at, k) as stop, row_number() over (partition by conv_id, turn order by piece_at, k) - 1 as pos from t)
select conv_id, turn, cast(pos as integer) as pos, id, cast(stop - size as integer) as start, cast(stop as integer) as "end" from o""")
def sql_token_rows(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark, public(), "wft")
    return spark.sql("select c.conv_id, c.turn, t.pos, t.id, t.start, t.end from {rows} c, lateral wft_tokens(c.text) t", rows=table(spark, d, "conversations"))


@query("stream_counts_by_lang", f"with recursive {_DOCS}, {_IDS} select lang, count(*) as texts, cast(sum(n) as bigint) as tokens from done join documents using (doc_id) group by lang")
def stream_counts_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """All documents as a stream of files: running counts in complete mode, read when the stream has come to its end."""
    from .streaming import count_stream

    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet*")
    name = f"counts_{uuid.uuid4().hex}"
    count_stream(stream, Tokenizer(public()), "lang").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


# corpus files: the documents are written as text files first, as the tables hold none


def _files(spark: SparkSession, d: str) -> str:
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    table(spark, d, "documents").select("text").write.option("lineSep", _END).option("maxRecordsPerFile", _PER_FILE).text(path)
    return path


_END = "<|endoftext|>"
#: A file is read whole by one task where order matters, so files don't grow with the table.
_PER_FILE = 4096


@query("v14_count_tokens_of_files", f"with recursive {_DOCS}, {_IDS} select count(*) as documents, cast(sum(n) as bigint) as tokens from done where text <> ''")
def v14(spark: SparkSession, d: str) -> DataFrame:
    return Tokenizer(public()).count_tokens_files(spark, _files(spark, d), _END)


@query("d9_encode_files", f"with recursive {_DOCS}, {_IDS} select {_SPELLED} as digest, n, true as in_a_row from done where text <> ''")
def d9(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents in files; their places lie in a row, each where the one before ends."""
    from pyspark.sql import Window

    own = Tokenizer(public()).encode_files_flat(spark, _files(spark, d), _END)
    before = F.lag(F.col("start") + F.col("n"), 1, 0).over(Window.partitionBy("path").orderBy("doc_pos"))
    first = F.col("doc_pos") == F.min("doc_pos").over(Window.partitionBy("path"))
    return own.select(digest(F.col("ids")).alias("digest"), "n", (first | (before == F.col("start"))).alias("in_a_row"))
