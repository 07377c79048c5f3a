"""The tokenization operators as queries over the tables, whole, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toy_models
from .functions import arrays, normalize, pretokenize
from .operators import diff, encode
from .operators.tokenizer import Tokenizer
from .plans import dedup
from .sources.documents import spread
from .spec import ModelSpec, Padding, Template, Truncation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
BYTES = toy_models.bpe_bytes(template=Template.bert(1, 2), pretokenizer="gpt2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def spelled(ids: Column) -> Column:
    return F.array_join(ids, " ")


def documents(name: str, column: Callable[[Column], Column], sql: str | None = None, out: str = "result") -> None:
    """A query of one column for each document."""
    query(name, sql and f"select doc_id, {sql} as {out} from documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", column(F.col("text")).alias(out)))


# pretokenizers: the pieces' number and digest

_W = r"\s\p{Z}\x0b\x{85}"
_SUFFIX = "''(?:[sSdDmMtT]|[lL][lL]|[vV][eE]|[rR][eE])"
_L, _N = r"\p{L}", r"\p{N}"
_REST = rf"[^{_W}{_L}{_N}\x01]+"


def _marked(text: str, last: str) -> str:
    """The text with chr(1) before the last white space of each run that something follows: stands for the lookahead that RE2 lacks."""
    return rf"regexp_replace({text}, '([{last}])([^{_W}])', chr(1) || '\1\2', 'g')"


def _matches(text: str, pattern: str) -> str:
    return f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda x: x <> chr(1))"


def _gpt2(text: str) -> str:
    return _matches(_marked(text, _W), "|".join((*("''" + x for x in ("s", "t", "re", "ve", "m", "ll", "d")), f" ?{_L}+", f" ?{_N}+", f" ?{_REST}", f"[{_W}]+", r"\x01")))


def _like_cl100k(words: str, digits: str, marks: str = "") -> str:
    return _matches(_marked("text", r" \t\p{Z}"), "|".join((words, digits, rf" ?{_REST}[\r\n{marks}]*", rf"[{_W}]*[\r\n]+", f"[{_W}]+", r"\x01")))


_ONE = rf"[^\r\n{_L}{_N}\x01]?"
_CASELESS = r"\p{Lm}\p{Lo}\p{M}"
_UP, _LOW = rf"\p{{Lu}}\p{{Lt}}{_CASELESS}", rf"\p{{Ll}}{_CASELESS}"
_CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2CEAF}\x{2F800}-\x{2FA1F}"
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
_PIECES = {
    "gpt2": _gpt2("text"),
    "cl100k": _like_cl100k(rf"{_SUFFIX}|{_ONE}\p{{L}}+", r"\p{N}{1,3}"),
    "o200k": _like_cl100k(rf"{_ONE}[{_UP}]*[{_LOW}]+(?:{_SUFFIX})?|{_ONE}[{_UP}]+[{_LOW}]*(?:{_SUFFIX})?", r"\p{N}{1,3}", "/"),
    "voyage": _like_cl100k(rf"{_SUFFIX}|{_ONE}\p{{L}}+", r"\p{N}"),
    "smollm": rf"flatten(list_transform(regexp_extract_all(text, '\p{{N}}|[^\p{{N}}]+'), lambda s: {_gpt2('s')}))",
    "qwen": _like_cl100k(rf"{_SUFFIX}|{_ONE}[\p{{L}}\p{{M}}]+", r"\p{N}"),
    "bert": rf"regexp_extract_all(text, '[{_CJK}]|[{_PUNCT}]|[^{_W}{_PUNCT}{_CJK}]+')",
}


def _pretokenizer(k: int, name: str) -> None:
    sql = _PIECES.get(name)

    @query(f"p{k}_{name}_pieces", sql and f"with p as (select doc_id, {sql} as p from documents) select doc_id, cast(len(p) as integer) as n_pieces, md5(array_to_string(p, chr(2))) as digest from p")
    def run(spark: SparkSession, d: str) -> DataFrame:
        own = table(spark, d, "documents").select("doc_id", encode.split_text(F.col("text"), name).alias("p"))
        return own.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x02")).alias("digest"))


for _k, _name in enumerate(("gpt2", "cl100k", "o200k", "voyage", "smollm", "deepseek", "qwen", "bert"), 1):
    if _name != "deepseek":
        _pretokenizer(_k, _name)

# normalizers

_CLEANED = r"regexp_replace(regexp_replace(text, '[\p{Cc}\p{Cf}\p{Co}\x{FFFD}]', '', 'g'), '\p{Zs}', ' ', 'g')".replace("regexp_replace(text", r"regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   ')")
_FLAT = rf"regexp_replace(regexp_replace(text, '[{_W}]+', ' ', 'g'), '^ | $', '', 'g')"
_norm = lambda *steps: lambda c: normalize.normalize(c, steps)
documents("n1_identity", _norm(), "text")
documents("n2_bert_cased", _norm(*normalize.BERT_CASED), _CLEANED)
documents("n3_bert_uncased", _norm(*normalize.BERT_UNCASED), f"lower(strip_accents({_CLEANED}))")
documents("n4_strip_accents", _norm(("strip_accents",)), "strip_accents(text)")
documents("n5_nfc", _norm(("nfc",)), "nfc_normalize(text)")
documents("n6_metaspace", _norm(("metaspace", "always")), "case when text = '' then text else '▁' || replace(text, ' ', '▁') end")
documents("n6_metaspace_unless_led", _norm(("metaspace", "unless_led")), "case when text = '' then text else case when text[1] in (' ', '▁') then '' else '▁' end || replace(text, ' ', '▁') end")
documents("n7_metaspace_replace", _norm(("metaspace", "never")), "replace(text, ' ', '▁')")
documents("n8_sentencepiece", _norm(("sentencepiece",)), f"'▁' || replace({_FLAT}, ' ', '▁')")
documents("n9_sentencepiece_lowercase", _norm(("sentencepiece_lowercase",)), f"lower('▁' || replace({_FLAT.replace('(text', '(strip_accents(text)')}, ' ', '▁'))")
documents("n14_find_and_replace", lambda c: normalize.find_and_replace(c, " the ", "---"), "replace(text, ' the ', '---')")
documents("n15_contains", lambda c: c.contains(" the "), "contains(text, ' the ')")

# documents


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


LETTERS, WORDS = toy_models.letters(), toy_models.words()
_TOKEN = {i: t.decode("latin-1") for i, t in LETTERS.vocab}
_MERGES = _values([(k, _TOKEN[a], _TOKEN[b]) for k, (a, b, _) in enumerate(LETTERS.merges)])


@query("d2_tokens_by_lang", rf"""with recursive merges(r, a, b) as (values {_MERGES}), pieces as (select lang, unnest({_gpt2('text')}) as piece from documents), words as (select distinct piece as w from pieces),
s(w, r, x) as (select w, 0, regexp_replace(w, '((?s).)', chr(1) || '\1' || chr(2), 'g') from words union all
select s.w, s.r + 1, replace(s.x, chr(1) || m.a || chr(2) || chr(1) || m.b || chr(2), chr(1) || m.a || m.b || chr(2)) from s join merges m on m.r = s.r),
n as (select w, strlen(w) - (length(w) - len(regexp_extract_all(x, '\x01'))) as n from s where r = (select count(*) from merges))
select lang, count(*) as n_pieces, cast(sum(n) as bigint) as n_tokens from pieces join n on n.w = piece group by lang""")
def d2(spark: SparkSession, d: str) -> DataFrame:
    """Pieces and ids by language: pieces are counted first, so each is encoded once."""
    pieces = table(spark, d, "documents").select("lang", F.explode(Tokenizer(LETTERS).pieces(F.col("text"))).alias("piece")).groupBy("lang", "piece").agg(F.count("*").alias("times"))
    sizes = dedup.piece_ids(pieces, LETTERS).select("piece", F.size("ids").alias("n"))
    return pieces.join(sizes, "piece").groupBy("lang").agg(F.sum("times").alias("n_pieces"), F.sum(F.col("times") * F.col("n")).alias("n_tokens"))


@query("d1_encode", "with i as (select p_partkey, list_transform(string_split(p_name, ''), lambda x: unicode(x)) as ids from part) select p_partkey, '1 ' || array_to_string(ids, ' ') || ' 2' as ids, len(ids) + 2 as n_mask, 0 as sum_types from i")
def d1(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "part").select("p_partkey", Tokenizer(BYTES).encode(F.col("p_name")).alias("e"))
    return e.select("p_partkey", spelled(F.col("e.ids")).alias("ids"), F.size("e.attention_mask").cast("bigint").alias("n_mask"), F.aggregate("e.type_ids", F.lit(0), lambda a, x: a + x).alias("sum_types"))


# arrays of ids: the bytes of names

_NAME = "list_transform(string_split(p_name, ''), lambda x: unicode(x))"


def _parts(name: str, column: Callable[[Column], Column], sql: str) -> None:
    query(name, f"with i as (select p_partkey, {_NAME} as ids from part) select p_partkey, {sql} as result from i")(
        lambda spark, d: table(spark, d, "part").select("p_partkey", spelled(column(Tokenizer(BYTES).raw_ids(F.col("p_name")))).alias("result"))
    )


_parts("a1_truncate_right", lambda x: arrays.truncate(x, Truncation(8), 2), "array_to_string(ids[1:6], ' ')")
_parts("a1_truncate_left", lambda x: arrays.truncate(x, Truncation(8, direction="left"), 2), "array_to_string(ids[greatest(len(ids) - 5, 1):], ' ')")
_parts("a3_template", lambda x: arrays.single(x, Template.bert(101, 102)), "'101 ' || array_to_string(ids, ' ') || ' 102'")
_parts("a7_pad_right", lambda x: arrays.pad(x, 24, F.lit(0)), "array_to_string(list_concat(ids, list_transform(range(greatest(24 - len(ids), 0)), lambda k: 0)), ' ')")
_parts("a7_pad_left", lambda x: arrays.pad(x, 24, F.lit(0), "left"), "array_to_string(list_concat(list_transform(range(greatest(24 - len(ids), 0)), lambda k: 0), ids), ' ')")
_parts("a10_attention_mask", arrays.attention_mask, "array_to_string(list_transform(ids, lambda x: 1), ' ')")
_parts("a12_special_tokens_mask", lambda x: arrays.special_tokens_mask(x, (97, 101)), "array_to_string(list_transform(ids, lambda x: case when x in (97, 101) then 1 else 0 end), ' ')")
for _strategy, _first, _second in (
    ("longest_first", "case when a + b <= 16 then a when least(a, b) * 2 <= 16 then case when a >= b then 16 - b else a end else 8 end", "case when a + b <= 16 then b when least(a, b) * 2 <= 16 then case when a >= b then b else 16 - a end else 8 end"),
    ("only_first", "greatest(a - greatest(a + b - 16, 0), 0)", "b"),
    ("only_second", "a", "greatest(b - greatest(a + b - 16, 0), 0)"),
):
    query(f"a2_pair_{_strategy}", f"with l as (select p_partkey, length(p_name) as a, length(p_brand) as b from part) select p_partkey, cast({_first} as integer) as n_first, cast({_second} as integer) as n_second from l")(
        lambda spark, d, s=_strategy: table(spark, d, "part").select("p_partkey", *[F.size(x).alias(n) for x, n in zip(arrays.truncate_pair(Tokenizer(BYTES).raw_ids(F.col("p_name")), Tokenizer(BYTES).raw_ids(F.col("p_brand")), Truncation(16, strategy=s)), ("n_first", "n_second"))])
    )


@query("a4_pair_template", "select p_partkey, '101 ' || array_to_string(list_transform(string_split(p_name, ''), lambda x: unicode(x)), ' ') || ' 102 ' || array_to_string(list_transform(string_split(p_brand, ''), lambda x: unicode(x)), ' ') || ' 102' as ids, length(p_brand) + 1 as n_second from part")
def a4(spark: SparkSession, d: str) -> DataFrame:
    t = Tokenizer(ModelSpec(encoder="bpe", vocab=BYTES.vocab, template=Template.bert(101, 102)))
    e = table(spark, d, "part").select("p_partkey", t.encode_pair(F.col("p_name"), F.col("p_brand")).alias("e"))
    return e.select("p_partkey", spelled(F.col("e.ids")).alias("ids"), F.aggregate("e.type_ids", F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_second"))


# decoding, vocabulary, comparison

documents("v2_round_trip", lambda c: Tokenizer(LETTERS).decode(Tokenizer(LETTERS).raw_ids(c)), "text", "text")


# the corpus


from . import public_queries as public_queries  # noqa: E402  its queries are registered here too
