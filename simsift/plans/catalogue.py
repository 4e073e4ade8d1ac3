"""Named queries over the driver tables, with their SQL counterparts.

Every query returns plain columns: arrays are written as text, doubles are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import hashing
from ..functions import text as tx
from ..functions.similarity import hamming
from ..operators import encode as enc
from ..operators import evaluate as ev
from ..operators.docvectors import DocVectors, neighbour_share
from ..operators.hamming import BlockIndex
from ..operators.jaccard import jaccard_pairs, jaccard_topk
from ..operators.minhash import PRIME, MinHash, MinHashIndex, compat_permutations, permutations
from ..operators.multi_index import nearest
from ..operators.prefix import PrefixIndex
from ..session import scratch, stored
from ..sources import datasets, posts, sinks
from ..streaming import ingest
from .tables import bits, kept_titles, table, texts, titles, turns, vectors, whole_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "lsh_topk"


def query(sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# -- pieces of SQL -------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_CLEAN = "lower(regexp_replace({c}, '[^a-zA-Z0-9 \\n]+', '', 'g'))"
_WORDS = "list_filter(string_split_regex(coalesce(" + _CLEAN + ", ''), '[ \\n]+'), lambda w: w <> '')"
_TOKENS = "list_filter(" + _WORDS + f", lambda w: w not in ({_STOP}))"


def _text(template: str, column: str = "text") -> str:
    return template.format(c=column)


_TITLES = f"titles as (select doc_id as id, ({_text(_TOKENS)})[1:16] as tokens from documents), t as (select * from titles where len(tokens) > 0)"
_WHOLE = f"t as (select * from (select doc_id as id, {_text(_TOKENS)} as tokens from documents) where len(tokens) > 0)"
_LE32 = "('0x' || substr(sha1({x}), 7, 2) || substr(sha1({x}), 5, 2) || substr(sha1({x}), 3, 2) || substr(sha1({x}), 1, 2))::UBIGINT::BIGINT"


def _signed(n: int = 128, source: str = "t") -> str:
    a, b = zip(*permutations(n), strict=True)
    hashes = f"list_transform(list_distinct(tokens), lambda w: {_LE32.format(x='w')} % {PRIME})"
    sig = f"list_transform(range(1, {n + 1}), lambda i: list_min(list_transform(hs, lambda h: ({list(a)}[i] * h + {list(b)}[i]) % {PRIME})))"
    return f"{source}_h as (select id, {hashes} as hs from {source}), {source}_sig as (select id, {sig} as sig from {source}_h)"


_BANDS = 25, 5
_BANDED = "select id, i as band, sig[i * 5 + 1 : i * 5 + 5] as key from {t}_sig, range(0, 25) r(i)"
_SIM = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] = p[2])::INT)) / 128.0"
_BITS = "list_transform(embedding, lambda v: (v > 0)::INT)"
_HAM = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] <> p[2])::INT)) / len({a})"


def _joined(column: str) -> str:
    return f"array_to_string({column}, ' ')"


# -- cleaning and words --------------------------------------------------------------------------


@query(f"select doc_id, {_text(_CLEAN)} as cleaned from documents")
def clean_text(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(f"select item_id, {_joined(_text(_TOKENS))} as words, len({_text(_TOKENS)})::INT as n_words from benchmark")
def clean_query_tokens(spark, sf_dir):
    words = tx.clean_query(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("words"), F.size(words).alias("n_words"))


@query(f"with {_TITLES} select id, {_joined('tokens')} as tokens from titles")
def doc_tokens16(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query(f"with {_TITLES} select id, {_joined('tokens')} as tokens from t")
def title_stream(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), tx.clean(F.col("text")).alias("title"))
    return posts.title_tokens(rows).select("id", F.array_join("tokens", " ").alias("tokens"))


@query(f"select doc_id, count(*) as n_words from (select doc_id, unnest({_text(_WORDS)}) as word from documents) where word not in ({_STOP}) group by doc_id")
def stopword_anti_join(spark, sf_dir):
    stop = spark.createDataFrame([(w,) for w in tx.STOP_WORDS], "word string")
    words = texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(tx.words(tx.clean(F.col("text")))).alias("word"))
    return words.join(F.broadcast(stop), "word", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


@query(f"select word, count(*) as n from (select unnest({_text(_WORDS)}) as word from documents) group by word having count(*) >= 2")
def vocabulary(spark, sf_dir):
    words = texts(spark, sf_dir, "documents", "text").select(F.explode(tx.words(tx.clean(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)


@query(f"select id, (u.i - 1)::INT as place, ws[u.i] as word from (select doc_id as id, {_text(_WORDS)} as ws from documents), lateral unnest(range(1, len(ws) + 1)) u(i)")
def body_words(spark, sf_dir):
    rows = texts(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), tx.clean(F.col("text")).alias("body"))
    return posts.body_words(rows)


@query(f"select (row_number() over (order by doc_id) - 1) as tag, {_joined(_text(_WORDS))} as words from documents")
def title_sentences_tagged(spark, sf_dir):
    rows = posts.with_ordinal(texts(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")  # cleaned once they are in order
    tagged = posts.sentences(rows.select("ordinal", tx.clean(F.col("text")).alias("title")))
    return tagged.select(F.col("tag").cast("long").alias("tag"), F.array_join("words", " ").alias("words"))


def _slice(lo: int, hi: int, exclusive: bool = False):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id")
        kept = posts.posts_in_range(docs, lo, hi, "doc_id", answer=F.lit(False), exclusive=exclusive)
        return kept.select("doc_id", F.col("ordinal").cast("long").alias("ordinal"))

    return run


_ORDINAL = "select * from (select doc_id, row_number() over (order by doc_id) as ordinal from documents) where ordinal between {} and {}"
QUERIES |= {"doc_slice_train": _slice(0, 100), "doc_slice_test": _slice(100, 140), "doc_slice_strict": _slice(100, 140, True)}
ORACLES |= {"doc_slice_train": _ORDINAL.format(1, 100), "doc_slice_test": _ORDINAL.format(100, 140), "doc_slice_strict": _ORDINAL.format(101, 140)}


@query("select page_id, length(html) as n_html from pages where page_id = 7")
def post_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    return posts.find_post(pages, 7).select(F.col("id").alias("page_id"), F.length("html").cast("long").alias("n_html"))


@query()
def strip_html_pages(spark, sf_dir):
    pages = texts(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", tx.strip_html(F.col("html")).alias("text"), tx.clean_string(F.col("html")).alias("cleaned"))


# -- features ------------------------------------------------------------------------------------

_WORD_ROWS = f"with w as (select distinct unnest({_text(_TOKENS)}) as word from documents)"
_COUNTS = "list_transform(range(97, 129), lambda k: len(list_filter(string_split(word, ''), lambda c: c <> '' and unicode(c) = k)))"


def _distinct_words(spark, sf_dir):
    return texts(spark, sf_dir, "documents", "text").select(F.explode(tx.clean_query(F.col("text"))).alias("word")).distinct()


@query(f"{_WORD_ROWS} select word, array_to_string({_COUNTS}, ' ') as counts from w")
def letter_histogram(spark, sf_dir):
    counts = F.transform(ft.histogram(F.col("word")), lambda c: c.cast("int").cast("string"))
    return _distinct_words(spark, sf_dir).select("word", F.array_join(counts, " ").alias("counts"))


@query(f"{_WORD_ROWS}, h as (select word, {_COUNTS} as c from w) select word, array_to_string(list_transform(c, lambda x: case when list_max(c) = 0 then 0 else round_even(x / list_max(c), 0)::INT end), ' ') as bits from h")
def letter_histogram_binarized(spark, sf_dir):
    found = ft.binarized(ft.histogram(F.col("word")))
    return _distinct_words(spark, sf_dir).select("word", F.array_join(F.transform(found, lambda c: c.cast("int").cast("string")), " ").alias("bits"))


def _matrices(spark, sf_dir):
    return kept_titles(spark, sf_dir).select("id", ft.matrix(F.col("tokens"), 32, 16, lambda w: ft.binarized(ft.histogram(w))).alias("x"))


def _shown(column):
    return F.array_join(F.transform(column, lambda c: c.cast("int").cast("string")), "")


_BINARY = _COUNTS.replace("string_split(word, '')", "string_split(tokens[r], '')")
_ROW = f"list_transform({_BINARY}, lambda x: case when list_max({_BINARY}) = 0 then 0 else round_even(x / list_max({_BINARY}), 0)::INT end)"
_MATRIX = (
    f"with {_TITLES}, cells as (select id, r, {_ROW} as row from t, lateral unnest(range(1, len(tokens) + 1)) u(r)), "
    "m as (select t.id, r.i as r, coalesce(c.row, list_transform(range(0, 32), lambda i: 0)) as row from t cross join range(1, 17) r(i) left join cells c on c.id = t.id and c.r = r.i)"
)


@query(f"{_MATRIX} select id, string_agg(array_to_string(row, ''), '' order by r) as x from m group by id")
def sentence_matrix(spark, sf_dir):
    return _matrices(spark, sf_dir).select("id", _shown("x").alias("x"))


def _picked(salt: str, n: int, name: str = "picked") -> str:
    key = f"md5('{salt}' || ':' || '1:' || id || ':' || i)"
    ranked = f"select id, i, row_number() over (partition by id order by {key}, i) as k from t cross join range(0, 16) r(i)"
    return f"{name} as (select * from ({ranked}) where k <= {n})"


_MOVED = (
    "moves as (select a.id, a.i as to_row, b.i as from_row from picked a join picked b on a.id = b.id and b.k = a.k % 3 + 1), "
    "moved as (select m.id, m.r, coalesce(v.from_row + 1, m.r) as src from m left join moves v on v.id = m.id and v.to_row = m.r - 1), "
    "swapped as (select v.id, v.r, m.row from moved v join m on m.id = v.id and m.r = v.src)"
)


@query(f"{_MATRIX}, {_picked('drop', 3)} select m.id, string_agg(case when q.i is null then array_to_string(row, '') else repeat('0', 32) end, '' order by r) as x from m left join picked q on q.id = m.id and q.i = m.r - 1 group by m.id")
def noise_drop_words(spark, sf_dir):
    return _matrices(spark, sf_dir).select("id", _shown(ft.drop_rows(F.col("x"), 32, 3, F.concat(F.lit("1:"), F.col("id")))).alias("x"))


_DRAWN = "g as (select distinct id, ('0x' || substr(md5('draw:1:' || id || ':' || k), 1, 8))::BIGINT % 16 as i from t cross join range(1, 9) d(k))"


@query(f"{_MATRIX}, {_DRAWN} select m.id, string_agg(case when g.i is null then array_to_string(row, '') else repeat('0', 32) end, '' order by r) as x from m left join g on g.id = m.id and g.i = m.r - 1 group by m.id")
def noise_drawn_words(spark, sf_dir):
    """Words dropped by eight draws with replacement."""
    return _matrices(spark, sf_dir).select("id", _shown(ft.drop_drawn_rows(F.col("x"), 32, 8, F.concat(F.lit("1:"), F.col("id")))).alias("x"))


@query(f"{_MATRIX}, {_picked('swap', 3)}, {_MOVED} select id, string_agg(array_to_string(row, ''), '' order by r) as x from swapped group by id")
def noise_swap_words(spark, sf_dir):
    return _matrices(spark, sf_dir).select("id", _shown(ft.swap_rows(F.col("x"), 32, 3, F.concat(F.lit("1:"), F.col("id")))).alias("x"))


@query(f"{_MATRIX}, {_picked('swap', 3)}, {_MOVED}, {_picked('drop', 3, 'gone')} select s.id, string_agg(case when g.i is null then array_to_string(row, '') else repeat('0', 32) end, '' order by r) as x, string_agg(array_to_string(row, ''), '' order by r) as x_hat from swapped s left join gone g on g.id = s.id and g.i = s.r - 1 group by s.id")
def title_training_set(spark, sf_dir):
    made = datasets.title_set(titles(spark, sf_dir), 32, lambda w: ft.binarized(ft.histogram(w)), drop=3, swap=3)
    return made.select("id", _shown("x").alias("x"), _shown("x_hat").alias("x_hat"))


@query()
def synthetic_training_set(spark, sf_dir):
    return datasets.resolve("example", spark, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))).select("id", _shown("x").alias("x"), _shown("x_hat").alias("x_hat"))


@query("select round(min(v), 6) as low, round(max(v), 6) as high from (select unnest(embedding)::DOUBLE as v from embeddings)")
def feature_minmax(spark, sf_dir):
    """The extremes of all features, as the pass that writes them has seen them."""
    v = F.col("vec")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    seen = sinks.write_observed(rows, scratch(spark, "features"), low=F.min(F.array_min(v)), high=F.max(F.array_max(v)))
    out = spark.createDataFrame([(seen["low"], seen["high"])], "low double, high double")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("select label, i::INT as i, round(avg(embedding[i + 1]::DOUBLE), 6) as mean from embeddings, range(0, 64) r(i) group by label, i")
def mean_pool_by_label(spark, sf_dir):
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda v: greatest(0.0, least(1.0, (v::DOUBLE + 0.5) * 1.0)))), 6) as total from embeddings")
def rescale_clamp(spark, sf_dir):
    scaled = ft.rescale(F.transform("embedding", lambda v: v.cast("double")), -0.5, 0.5, 0.0, 1.0)
    total = F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total, 6).alias("total"))


@query("select vec_id, array_to_string(list_transform(embedding, lambda v: (v > 0.1)::INT), '') as bits from embeddings")
def threshold_binarize(spark, sf_dir):
    found = ft.threshold(F.transform("embedding", lambda v: v.cast("double")), 0.1)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(found, lambda b: b.cast("string")), "").alias("bits"))


@query("select vec_id, array_to_string(flatten(list_transform(embedding, lambda v: list_transform(range(1, 17), lambda i: (floor((abs(v::DOUBLE) - floor(abs(v::DOUBLE))) * pow(2.0, i)) % 2)::INT))), '') as digits from embeddings")
def binary_fraction_digits(spark, sf_dir):
    digits = ft.vector_digits(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(digits, lambda d: d.cast("string")), "").alias("digits"))


@query("select vec_id, array_to_string(list_transform(embedding, lambda v: v::FLOAT::BIT::VARCHAR), '') as bits from embeddings")
def float_bit_strings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", ft.float_bits(F.col("embedding")).alias("bits"))


# -- hashes --------------------------------------------------------------------------------------


@query(f"{_WORD_ROWS} select word, {_LE32.format(x='word')} as hash from w")
def sha1_le32(spark, sf_dir):
    return _distinct_words(spark, sf_dir).select("word", hashing.sha1_le32(F.col("word")).alias("hash"))


@query()
def other_hashes(spark, sf_dir):
    return _distinct_words(spark, sf_dir).select("word", hashing.sha3_le32(F.col("word")).alias("sha3"), hashing.xxh32_le32(F.col("word")).alias("xxh32"))


@query()
def digest_floats(spark, sf_dir):
    pair = hashing.digest_floats(F.unhex(F.sha1(F.col("word").cast("binary"))))
    return _distinct_words(spark, sf_dir).select("word", pair[0].cast("string").alias("first"), pair[1].cast("string").alias("second"))


# -- MinHash index -------------------------------------------------------------------------------


@query(f"with {_TITLES}, {_signed()} select id, array_to_string(sig, ',') as sig from t_sig")
def minhash_signature(spark, sf_dir):
    return MinHash().signatures(titles(spark, sf_dir)).select("id", F.array_join(F.transform("sig", lambda s: s.cast("string")), ",").alias("sig"))


@query(f"with {_TITLES}, {_signed()} select id, array_to_string(sig, ',') as sig from t_sig")
def minhash_signature_rows(spark, sf_dir):
    """Signatures as aggregates of rows of one token each, every other one in a second part that is merged."""
    rows = kept_titles(spark, sf_dir).select("id", F.posexplode("tokens").alias("place", "token"))
    method = MinHash()
    parts = [method.signatures_of_rows(rows.where(F.col("place") % 2 == i)) for i in (0, 1)]
    return method.merged(parts[0].union(parts[1])).select("id", F.array_join(F.transform("sig", lambda s: s.cast("string")), ",").alias("sig"))


@query(f"with {_WHOLE}, {_signed()} select id, band::INT as band, array_to_string(key, ',') as key from ({_BANDED.format(t='t')})")
def minhash_bands(spark, sf_dir):
    """Keys of the bands of whole texts."""
    method = MinHash()
    keys = method.band_keys(stored(method.signatures(whole_texts(spark, sf_dir)), "signatures"))
    return keys.select("id", "band", F.array_join(F.transform("key", lambda s: s.cast("string")), ",").alias("key"))


_CLASSES = "classes as (select sig, min(id) as id, count(*) as n from t_sig group by sig), c_sig as (select id, sig from classes)"


@query(f"with {_TITLES}, {_signed()}, {_CLASSES}, b as ({_BANDED.format(t='c')}), p as (select distinct x.id as a, y.id as b from b x join b y using (band, key) where x.id < y.id) select a, b, round({_SIM.format(a='u.sig', b='v.sig')}, 6) as similarity from p join c_sig u on u.id = a join c_sig v on v.id = b")
def lsh_candidates(spark, sf_dir):
    found = MinHashIndex.build(titles(spark, sf_dir)).candidates()
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


def _topk_sql(asked: str, asked_cte: str = "") -> str:
    return (
        f"with {_TITLES}{asked_cte}, {_signed()}, b as ({_BANDED.format(t='t')}), q as ({_BANDED.format(t=asked)}), "
        "p as (select distinct q.id as query, b.id as id from q join b using (band, key)), "
        f"s as (select query, p.id, {_SIM.format(a='u.sig', b='v.sig')} as similarity from p join {asked}_sig u on u.id = query join t_sig v on v.id = p.id) "
        "select query, id, round(similarity, 6) as similarity, place::INT as place from (select *, row_number() over (partition by query order by similarity desc, id) as place from s) where place <= 10"
    )


@query(_topk_sql("t"))
def lsh_topk(spark, sf_dir):
    items = kept_titles(spark, sf_dir)
    found = MinHashIndex.build(items).search(items)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


@query(_topk_sql("a", f", a as (select item_id as id, ({_text(_TOKENS)}) as tokens from benchmark), {_signed(source='a')}"))
def search_benchmark_queries(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tx.clean_query(F.col("text")).alias("tokens"))
    found = MinHashIndex.build(titles(spark, sf_dir)).search(asked)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


_BENCHMARK_SQL = _topk_sql("a", f", a as (select item_id as id, ({_text(_TOKENS)}) as tokens from benchmark), {_signed(source='a')}")


@query(f"select r.*, {_joined('k.tokens')} as title from ({_BENCHMARK_SQL}) r left join (with {_TITLES} select * from t) k on k.id = r.id")
def search_results_titled(spark, sf_dir):
    """Search results with the titles of what was found, written as tab-separated files and read back."""
    items, path = titles(spark, sf_dir), scratch(spark, "results")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tx.clean_query(F.col("text")).alias("tokens"))
    sinks.write_results(ev.with_titles(MinHashIndex.build(items).search(asked), items), path)
    kinds = "query long, place int, id long, similarity double, title string"
    found = spark.read.schema(kinds).option("header", True).option("sep", "\t").csv(path)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "place", "title")


@query(f"with {_TITLES} select count(*) as index_size from t")
def lsh_index_size(spark, sf_dir):
    """Built from one half, the other inserted, saved and loaded."""
    items = titles(spark, sf_dir)
    index = MinHashIndex.build(items.where("id % 2 = 0")).insert(items.where("id % 2 = 1"))
    path = scratch(spark, "minhash-index")
    index.save(path)
    return MinHashIndex.load(spark, path).size()


_SETS = "s as (select id, list_sort(list_distinct(tokens)) as tokens from t)"
_CLASS_SETS = f"{_SETS}, k as (select min(id) as id, tokens from s group by tokens)"


def _jaccard_sql(left: str, right: str, where: str) -> str:
    """(a, b, similarity) of sets of two tables (id, tokens)."""
    words = f"wa as (select id, unnest(tokens) as word from {left}), wb as (select id, unnest(tokens) as word from {right})"
    pairs = f"p as (select x.id as a, y.id as b, count(*) as common from wa x join wb y using (word) where {where} group by 1, 2)"
    return f"{words}, {pairs}, j as (select a, b, common / (len(u.tokens) + len(v.tokens) - common) as similarity from p join {left} u on u.id = a join {right} v on v.id = b where common * 2 >= len(u.tokens) + len(v.tokens) - common)"


@query(f"with {_TITLES}, {_CLASS_SETS}, {_jaccard_sql('k', 'k', 'x.id < y.id')} select a, b, round(similarity, 6) as similarity from j union all select k.id as a, s.id as b, 1.0::DOUBLE as similarity from s join k using (tokens) where s.id <> k.id")
def exact_jaccard_pairs(spark, sf_dir):
    """Pairs of different sets of words, each named by its smallest title, that share half of their words; and every other
    title of a set with the one that names it."""
    pairs, members = jaccard_pairs(titles(spark, sf_dir))
    copies = members.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity")).unionByName(copies)


@query(f"with {_TITLES}, {_CLASS_SETS} select s.id, k.id as class from s join k using (tokens)")
def jaccard_members(spark, sf_dir):
    """Which set of words each title has."""
    return jaccard_pairs(titles(spark, sf_dir))[1].select("id", "class")


@query(f"with {_TITLES}, {_SETS}, q as (select * from s where id % 20 = 0), {_jaccard_sql('q', 's', 'true')} select a as query, b as id, round(similarity, 6) as similarity, place::INT as place from (select *, row_number() over (partition by a order by similarity desc, b) as place from j) where place <= 10")
def jaccard_topk_search(spark, sf_dir):
    """The most similar titles for every twentieth one, exactly."""
    items = titles(spark, sf_dir)
    return jaccard_topk(items, items.where("id % 20 = 0")).select("query", "id", F.round("similarity", 6).alias("similarity"), "place")


@query()
def lsh_recall(spark, sf_dir):
    """Of the exact nearest titles of every twentieth one, how many the banded index finds, by tenths of similarity, and
    how many its bands should find."""
    items = stored(titles(spark, sf_dir), "titles")
    asked = items.where("id % 20 = 0")
    method = MinHash()
    bands, rows = method.bands
    found = MinHashIndex.build(items, method).search(asked, 10).select("query", "id", F.lit(1).alias("hit"))
    wanted = jaccard_topk(items, asked).join(found, ["query", "id"], "left")
    expected = 1 - F.pow(1 - F.pow("similarity", F.lit(rows)), F.lit(bands))
    tenth = F.floor(F.col("similarity") * 10 + 1e-9) / 10
    return wanted.groupBy(tenth.alias("similarity")).agg(F.count(F.lit(1)).alias("wanted"), F.sum(F.coalesce("hit", F.lit(0))).alias("found"), F.round(F.sum(expected), 3).alias("expected"))


@query(f"with {_TITLES}, s as (select id, {_joined('tokens')} as s from t) select s.id, min(o.id) as first, count(*) as n from s join s o using (s) group by s.id")
def whole_string_match(spark, sf_dir):
    """Titles as one element: an index finds equal titles only."""
    index = MinHashIndex.build(titles(spark, sf_dir), MinHash(shingle="whole"))
    classes = index.members.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return index.members.join(classes, "class").select("id", F.col("class").alias("first"), "n")


def _compat_sql() -> str:
    a, b = zip(*compat_permutations(128), strict=True)
    wrapped = f"(({list(a)}[i]::HUGEINT * h + {list(b)}[i]::HUGEINT) % 18446744073709551616::HUGEINT) % {(1 << 61) - 1}::HUGEINT % 4294967296::HUGEINT"
    hashes = f"list_transform(list_distinct(tokens), lambda w: {_LE32.format(x='w')}::HUGEINT)"
    return f"with {_TITLES}, h as (select id, {hashes} as hs from t) select id, array_to_string(list_transform(range(1, 129), lambda i: list_min(list_transform(hs, lambda h: {wrapped}))), ',') as sig from h"


@query(_compat_sql())
def compat_signature(spark, sf_dir):
    signed = MinHash(compat=True).signatures(titles(spark, sf_dir))
    return signed.select("id", F.array_join(F.transform("sig", lambda s: s.cast("string")), ",").alias("sig"))


# -- Hamming and prefix indexes ------------------------------------------------------------------

_ENTRIES = f"e as (select vec_id as val, {_BITS} as key from embeddings), q as (select val as query, key as asked from e where val % 20 = 0)"


def _entries(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("vec").alias("key"), F.col("id").alias("val"))


def _asked(entries):
    return entries.where("val % 20 = 0").select(F.col("val").alias("query"), "key")


def _found(df):
    return df.select("query", "val", F.round("distance", 6).alias("distance"), "place")


_NEAREST = "select query, val, round(distance, 6) as distance, place::INT as place from (select *, row_number() over (partition by query order by distance, key, val) as place from d{w}) where place <= 10"


@query(f"with {_ENTRIES}, d as (select query, val, key, {_HAM.format(a='key', b='asked')} as distance from e, q) {_NEAREST.format(w=' where distance <= 0.125')}")
def hamming_bruteforce(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return _found(nearest(entries, _asked(entries), 0.125))


@query(f"with {_ENTRIES}, d as (select query, val, key, {_HAM.format(a='key', b='asked')} as distance from e, q) {_NEAREST.format(w='')}")
def hamming_topk(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    return _found(nearest(entries, _asked(entries), 1.0))


_BLOCKED = f"{_ENTRIES}, b as (select *, (row_number() over (order by key, val) - 1) // 50 as block from e)"


@query(f"with {_BLOCKED} select val, block, array_to_string(key, '') as key from b")
def block_sorted_index(spark, sf_dir):
    content = BlockIndex.build(_entries(spark, sf_dir), 50).content()
    return content.select("val", "block", F.array_join(F.transform("key", lambda b: b.cast("string")), "").alias("key"))


_BLOCK_SQL = f"with {_BLOCKED}, f as (select block, min(key) as first from b group by block), w as (select query, asked, coalesce(max(case when first <= asked then block end), 0) as block from q, f group by query, asked), d as (select query, val, key, {_HAM.format(a='key', b='asked')} as distance from w join b using (block)) {_NEAREST.format(w='')}"


def _block_query(spark, sf_dir, inserted: bool):
    entries = _entries(spark, sf_dir)
    path = scratch(spark, "block-index")
    index = BlockIndex.build(entries.where("val % 2 = 0"), 50).insert(entries.where("val % 2 = 1")) if inserted else BlockIndex.build(entries, 50)
    index.save(path)
    return _found(BlockIndex.load(spark, path).search(_asked(entries)))


@query(_BLOCK_SQL)
def block_inserted_search(spark, sf_dir):
    """Built from one half, the other inserted."""
    return _block_query(spark, sf_dir, True)


@query(_BLOCK_SQL)
def block_search(spark, sf_dir):
    return _block_query(spark, sf_dir, False)



_LCP = "coalesce(list_max(list_filter(range(1, len(x) + 1), lambda i: x[1:i] = y[1:i])), 0)"
_PREFIXED = f"with v as (select vec_id as id, {_BITS} as vec from embeddings), p as (select q.id as query, v.id, v.vec, q.vec as x, v.vec as y from v q, v where q.id % 20 = 0), s as (select query, id, vec, {_LCP} as length from p) select query, id, length::INT as length, place::INT as place from (select *, row_number() over (partition by query order by length desc, vec, id) as place from s where length >= 1) where place <= 10"


@query(_PREFIXED)
def prefix_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return PrefixIndex.build(rows, 64).search(rows.where("id % 20 = 0"), 10)


@query(_PREFIXED)
def prefix_inserted_topk(spark, sf_dir):
    """Built from one half, the other inserted."""
    rows = vectors(spark, sf_dir)
    index = PrefixIndex.build(rows.where("id % 2 = 0"), 64).insert(rows.where("id % 2 = 1"))
    return index.search(rows.where("id % 20 = 0"), 10)


@query(f"with v as (select vec_id as id, {_BITS} as vec from embeddings) select q.id as query, v.id from v q join v using (vec) where q.id % 20 = 0")
def exact_vector_lookup(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    path = scratch(spark, "prefix-index")
    PrefixIndex.build(rows, 64).save(path)
    return PrefixIndex.load(spark, path).lookup(rows.where("id % 20 = 0"))


@query(f"with v as (select vec_id as id, {_BITS} as vec from embeddings) select a.id as a, b.id as b, round({_HAM.format(a='a.vec', b='b.vec')}, 6) as distance from v a join v b on b.id = a.id + 1")
def hamming_neighbours(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), bits(F.col("embedding")).alias("vec"))
    pairs = v.toDF("a", "x").join(v.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("vec").alias("y")), "a")
    return pairs.select("a", "b", F.round(hamming(F.col("x"), F.col("y")), 6).alias("distance"))


# -- answers -------------------------------------------------------------------------------------

_TURNS = "o as (select *, row_number() over (order by conv_id, turn) as pos, role = 'assistant' as ans from conversations), p as (select *, case when not ans then row_number() over (partition by ans order by pos) end as post from o)"


def _positional_sql(lo: int, hi: int | None) -> str:
    keep = f"not ans and post >= {lo}" + (f" and post <= {hi}" if hi else "")
    return (
        f"with {_TURNS}, w as (select *, min(case when {keep} then pos end) over (order by pos rows between current row and unbounded following) as owner from p), "
        "a as (select owner, string_agg(conv_id || ':' || turn, ',' order by pos) as answers, count(*) as n from w where ans and owner is not null group by owner) "
        f"select w.conv_id, w.turn, w.post as post_ordinal, a.answers, a.n as n_answers from w left join a on a.owner = w.pos where {keep}"
    )


def _answered(found, *key):
    names = F.array_join(F.transform("answers", lambda a: F.concat_ws(":", *[a[k] for k in key])), ",")
    n = F.when(F.col("answers").isNotNull(), F.size("answers").cast("long"))
    return found.withColumns({"post_ordinal": F.col("post_ordinal").cast("long"), "answers": names, "n_answers": n})


def _positional(lo: int, hi: int):
    def run(spark, sf_dir):
        found = posts.attach_positional(turns(spark, sf_dir), F.col("role") == "assistant", "conv_id", "turn", lo=lo, hi=hi)
        return _answered(found, "conv_id", "turn").select("conv_id", "turn", "post_ordinal", "answers", "n_answers")

    return run


def _xml_turns(spark, sf_dir):
    """conversations written as XML dumps, in order, and read again in ranges of the files."""
    rows = turns(spark, sf_dir).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    path = scratch(spark, "turns-xml")
    kind = F.when(F.col("role") == "assistant", "2").otherwise("1")
    posts.write_posts(rows.select(F.concat_ws(":", "conv_id", "turn").alias("id"), kind.alias("post_type"), F.col("text").alias("body")), path)
    return posts.read_posts(spark, path)


QUERIES |= {"answers_positional": _positional(1, 0), "answers_positional_range": _positional(20, 60)}
ORACLES |= {"answers_positional": _positional_sql(1, None), "answers_positional_range": _positional_sql(20, 60)}


@query(_positional_sql(1, None))
def answers_positional_xml(spark, sf_dir):
    found = posts.attach_positional(_xml_turns(spark, sf_dir), posts.is_answer(F.col("post_type")), "file", "place")
    key = F.split("id", ":")
    return _answered(found, "id").select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "post_ordinal", "answers", "n_answers")


@query(_positional_sql(1, None))
def answers_positional_stream(spark, sf_dir):
    """conversations as a stream of four batches cut anywhere; the state carries answers over to the next post."""
    rows = posts.with_ordinal(turns(spark, sf_dir).select("conv_id", "turn", (F.col("role") == "assistant").alias("is_answer")), "conv_id", "turn", name="at")
    rows = stored(rows.select(F.lit("conversations").alias("source"), F.col("at").cast("long").alias("at"), F.concat_ws(":", "conv_id", "turn").alias("id"), "is_answer"), "turns")
    path, n = scratch(spark, "turns-stream"), rows.count()
    for i in range(4):  # files of a stream come in order of their time
        rows.where((F.col("at") > n * i // 4 - i) & (F.col("at") <= (n * (i + 1) // 4 - (i + 1) if i < 3 else n))).coalesce(1).write.mode("append").parquet(f"{path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows")
    ingest.write_stream(ingest.answers_stream(stream), f"{path}/answers", f"{path}/progress").awaitTermination()
    found, key = spark.read.parquet(f"{path}/answers"), F.split("id", ":")
    n_answers = F.when(F.col("answers").isNotNull(), F.size("answers").cast("long"))
    return found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "post_ordinal", F.array_join("answers", ",").alias("answers"), n_answers.alias("n_answers"))


@query("select conv_id, turn, role = 'assistant' as is_answer, length(text) as n_chars, sha256(text) as text_sha256 from conversations")
def xml_dump_rows(spark, sf_dir):
    found, key = _xml_turns(spark, sf_dir), F.split("id", ":")
    return found.select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), posts.is_answer(F.col("post_type")).alias("is_answer"), F.length("body").cast("long").alias("n_chars"), F.sha2("body", 256).alias("text_sha256"))


@query("with a as (select conv_id, turn, text from conversations where role = 'assistant'), p as (select conv_id, turn from conversations where role = 'user') select p.conv_id, p.turn, string_agg(a.turn::VARCHAR, ',' order by a.turn) as answers from p left join a on a.conv_id = p.conv_id and a.turn = p.turn + 1 group by p.conv_id, p.turn")
def answers_by_parent(spark, sf_dir):
    """An assistant turn answers the turn before it."""
    rows = turns(spark, sf_dir)
    asked = rows.where("role = 'user'").select(F.struct("conv_id", "turn").alias("id"), "conv_id", "turn")
    given = rows.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("parent_id"), F.col("turn").alias("at"))
    found = posts.attach_by_parent(asked, given, "id", "parent_id", "at")
    return found.select("conv_id", "turn", F.array_join(F.transform("answers", lambda a: a["at"].cast("string")), ",").alias("answers"))


@query("with a as (select conv_id, min(turn) as first, max(turn) as last from conversations where role = 'assistant' group by conv_id) select conv_id, last as accepted from a")
def accepted_answer(spark, sf_dir):
    """With the last assistant turn of a conversation as the accepted one."""
    given = turns(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("turn").alias("id"))).alias("answers"), F.max("turn").alias("wanted"))
    return given.select("conv_id", posts.accepted_answer(F.col("answers"), F.col("wanted"))["id"].alias("accepted"))


@query(f"with {_TITLES} select item_id, {_joined('tokens')} as title from benchmark left join t on t.id = item_id")
def title_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select("item_id")
    found = asked.join(titles(spark, sf_dir), F.col("item_id") == F.col("id"), "left")
    return found.select("item_id", F.array_join("tokens", " ").alias("title"))


# -- evaluation ----------------------------------------------------------------------------------

_DROPPED = f"list_filter(tokens, lambda w, i: i - 1 <> {_LE32.format(x=_joined('tokens'))} % len(tokens))"
_ASKED = f"asked as (select id, 'title' as kind, tokens from t union all select id, 'dropped', {_DROPPED} from t), a as (select struct_pack(id := id, kind := kind) as id, tokens from asked where len(tokens) > 0)"


def _compared_sql(tail: str) -> str:
    return (
        f"with {_TITLES}, {_ASKED}, {_signed(source='a')}, {_signed()}, b as ({_BANDED.format(t='t')}), q as ({_BANDED.format(t='a')}), "
        "p as (select distinct q.id as query, b.id as id from q join b using (band, key)), "
        f"s as (select query, p.id, {_SIM.format(a='u.sig', b='v.sig')} as similarity from p join a_sig u on u.id = query join t_sig v on v.id = p.id), "
        "k as (select *, row_number() over (partition by query order by similarity desc, id) as place from s), "
        "r as (select query, string_agg(id::VARCHAR, ',' order by place) as results, bool_or(id = query.id) as hit from k where place <= 10 group by query), "
        f"f as (select a.id.id as id, a.id.kind as kind, coalesce(results, '') as results, coalesce(hit, false) as sha1 from a left join r on r.query = a.id) {tail}"
    )


def _indexes(items, *names):
    return {n: ev.make_index(items, n) for n in names}


@query(_compared_sql("select id, kind, 'sha1' as index_name, results from f"))
def compare_searches(spark, sf_dir):
    items = kept_titles(spark, sf_dir)
    found = ev.compare(items, _indexes(items, "sha1"))
    return found.select("id", "kind", "index_name", F.array_join(F.transform("results", lambda r: r.cast("string")), ",").alias("results"))


@query(_compared_sql("select id, kind, sha1 from f"))
def hits_wide(spark, sf_dir):
    items = kept_titles(spark, sf_dir)
    return ev.hits(ev.compare(items, _indexes(items, "sha1")), ["sha1"])


@query(_compared_sql("select 'sha1' as index_name, sum(sha1::INT)::BIGINT as hits, count(*) as queries from f"))
def recall_sum(spark, sf_dir):
    items = kept_titles(spark, sf_dir)
    return ev.recall(ev.hits(ev.compare(items, _indexes(items, "sha1")), ["sha1"]), ["sha1"])


#: Titles that the encoders of the comparison are fitted on at most.
@query()
def recall_by_hash(spark, sf_dir):
    """The five indexes compared: SHA-1, xxh32 and SHA-3 over tokens, and the codes of a fully connected and of a
    convolutional encoder; each is asked for whole titles and for titles with a word left out."""
    items = stored(titles(spark, sf_dir), "titles")
    learned = {n: ev.make_index(items, n, latent=16, epochs=2) for n in ("fcn", "cnn")}
    indexes = _indexes(items, "sha1", "xxh32", "sha3") | learned
    names = list(indexes)
    return ev.recall(ev.hits(ev.compare(items, indexes), names), names)


# -- learned encodings ---------------------------------------------------------------------------


def _codes(spark, sf_dir, latent: int = 16):
    """(id, vec): bits of a fixed projection of each title's matrix."""
    projection = enc.projection(512, latent)
    codes = enc.encode(_matrices(spark, sf_dir), lambda x: x @ projection)
    return stored(codes.select("id", F.transform("code", lambda v: F.when(v > 0, 1).otherwise(0)).alias("vec")), "codes")


_PROJECTION = [int(v) for v in enc.projection(512, 16).T.ravel()]
_BIT = f"list_transform(range(0, 16), lambda k: (list_sum(list_transform(range(1, 513), lambda i: substr(x, i, 1)::INT * {_PROJECTION}[k * 512 + i])) > 0)::INT)"
_CODES = f"{_MATRIX}, x as (select id, string_agg(array_to_string(row, ''), '' order by r) as x from m group by id), v as (select id, {_BIT} as vec from x)"


@query(f"{_CODES} select id, array_to_string(vec, '') as code from v")
def learned_encode(spark, sf_dir):
    return _codes(spark, sf_dir).select("id", F.array_join(F.transform("vec", lambda v: v.cast("string")), "").alias("code"))


_TYPED = f"titles as (select item_id as id, ({_text(_TOKENS)})[1:16] as tokens from benchmark), t as (select * from titles)"


@query(f"{_CODES.replace(_TITLES, _TYPED)} select id, array_to_string(vec, '') as code from v")
def learned_query_codes(spark, sf_dir):
    """Codes of queries as they are typed, by the projection that learned_encode uses."""
    projection = enc.projection(512, 16)
    codes = ev.query_codes(table(spark, sf_dir, "benchmark"), lambda x: x @ projection, "item_id")
    return codes.select("id", F.array_join(F.transform("code", lambda v: F.when(v > 0, "1").otherwise("0")), "").alias("code"))


def _four_sql(tail: str) -> str:
    """r (query, index_name, id, place): what four indexes find for each title, whole and with a word left out."""
    named = f"{_TITLES.replace(', t as (', ', t0 as (')}, {_ASKED.replace('from t', 'from t0')}"
    every = "t as (select struct_pack(id := id, kind := 'item') as id, tokens from t0 union all select id, tokens from a)"
    coded = _CODES.replace(f"with {_TITLES}", f"with {named}, {every}")
    pairs = f"cp as (select q.id as query, v.id.id as id, v.vec, q.vec as x, v.vec as y from v q, v where q.id.kind <> 'item' and v.id.kind = 'item'), cl as (select query, id, vec, {_LCP} as length, {_HAM.format(a='x', b='y')} as distance from cp)"
    prefix = "select query, 'prefix' as index_name, id, row_number() over (partition by query order by length desc, vec, id) as place from cl where length >= 1"
    near = "select query, 'hamming' as index_name, id, row_number() over (partition by query order by distance, vec, id) as place from cl"
    whole = f"select a.id as query, 'whole' as index_name, t0.id as id, row_number() over (partition by a.id order by t0.id) as place from a join t0 on {_joined('a.tokens')} = {_joined('t0.tokens')}"
    signed = f"{_signed(source='a')}, {_signed(source='t0')}, b as ({_BANDED.format(t='t0')}), bq as ({_BANDED.format(t='a')}), bp as (select distinct bq.id as query, b.id as id from bq join b using (band, key)), "
    signed += f"bs as (select query, bp.id, {_SIM.format(a='bu.sig', b='bv.sig')} as similarity from bp join a_sig bu on bu.id = query join t0_sig bv on bv.id = bp.id)"
    sha1 = "select query, 'sha1' as index_name, id, row_number() over (partition by query order by similarity desc, id) as place from bs"
    return f"{coded}, {pairs}, {signed}, r as (select * from (({prefix}) union all ({near}) union all ({whole}) union all ({sha1})) where place <= 10), n as (select unnest(['hamming', 'prefix', 'sha1', 'whole']) as index_name) {tail}"


def _four(spark, sf_dir):
    items = stored(titles(spark, sf_dir), "titles")
    projection = enc.projection(512, 16)
    indexes = {"hamming": ev.CodeIndex(items, lambda x: x @ projection, 16, "hamming", 0.0), "prefix": ev.CodeIndex(items, lambda x: x @ projection, 16, "prefix", 0.0)}
    return items, indexes | {"sha1": ev.make_index(items), "whole": ev.make_index(items, whole=True)}


@query(_four_sql("select a.id.id as id, a.id.kind as kind, n.index_name, coalesce(string_agg(r.id::VARCHAR, ',' order by place), '') as results from a cross join n left join r on r.query = a.id and r.index_name = n.index_name group by all"))
def compare_four_indexes(spark, sf_dir):
    """What the bands of SHA-1, whole titles, prefixes of codes and Hamming distances of codes find for the same queries."""
    found = ev.compare(*_four(spark, sf_dir))
    return found.select("id", "kind", "index_name", F.array_join(F.transform("results", lambda r: r.cast("string")), ",").alias("results"))


@query(_four_sql("select n.index_name, count(r.id) as hits, (select count(*) from a) as queries from n left join r on r.index_name = n.index_name and r.id = r.query.id group by n.index_name"))
def recall_four_indexes(spark, sf_dir):
    items, indexes = _four(spark, sf_dir)
    names = list(indexes)
    return ev.recall(ev.hits(ev.compare(items, indexes), names), names)


@query(f"{_CODES} select v.id, array_to_string(vec, '') as code, {_joined('t.tokens')} as title from v join t on t.id = v.id")
def projector_codes(spark, sf_dir):
    """Codes with ids and titles as the projector's two files, read back row by row."""
    path = scratch(spark, "projector-codes")
    rows = _codes(spark, sf_dir).join(titles(spark, sf_dir), "id")
    sinks.write_projector(rows, path, F.col("vec"), F.col("id").alias("ID"), F.array_join("tokens", " ").alias("Title"))
    return sinks.read_projector(spark, path, "ID long, Title string").select(F.col("ID").alias("id"), F.array_join("vec", "").alias("code"), F.col("Title").alias("title"))


@query(f"{_CODES}, p as (select q.id as query, v.id, v.vec, q.vec as x, v.vec as y from v q, v where q.id % 20 = 0), s as (select query, id, vec, {_LCP} as length from p) select query, id, length::INT as length, place::INT as place from (select *, row_number() over (partition by query order by length desc, vec, id) as place from s where length >= 1) where place <= 10")
def learned_prefix_search(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    return PrefixIndex.build(codes, 16).search(codes.where("id % 20 = 0"), 10)


@query()
def learned_hash(spark, sf_dir):
    """The first coordinate of a code as a 32-bit hash."""
    projection = enc.projection(512, 1)
    codes = stored(enc.encode(_matrices(spark, sf_dir), lambda x: x @ projection), "codes")
    return codes.select("id", F.col("code")[0].alias("first")).select("id", hashing.float_le32(F.col("first")).alias("hash"))


@query()
def autoencoder_codes(spark, sf_dir):
    """A small autoencoder trained on all titles, with random words dropped and swapped, then used for all."""
    rows = stored(_matrices(spark, sf_dir), "matrices")
    net = ev.fitted(rows, "fcn", 32)
    shown = F.transform("code", lambda v: F.round(v.cast("double"), 6).cast("string"))
    return enc.encode(rows, net.encode).select("id", F.array_join(shown, " ").alias("code"))


_FIXED = "((h + k * 7919) % 1000 - 500) / 1000000.0"
_VECTOR = f"list_transform(range(0, 4), lambda k: case when {_LE32.format(x='w')} % 3 = 0 then 0.0001::DOUBLE else ({_FIXED.replace('h', '(' + _LE32.format(x='w') + ')', 1)})::DOUBLE end)"


def _fixed_vectors(items):
    """(word, vec) of two thirds of the words of titles: vectors of four components that a hash of the word gives."""
    h = hashing.sha1_le32(F.col("word"))
    vec = F.array(*[((h + k * 7919) % 1000 - 500) / F.lit(1_000_000.0) for k in range(4)])
    words = items.select(F.explode("tokens").alias("word")).distinct()
    return words.where(h % 3 != 0).select("word", vec.alias("vec"))


@query(f"with {_TITLES}, v as (select id, flatten(list_transform(tokens, lambda w: {_VECTOR})) as vs from t) select id, array_to_string(list_transform(range(1, 65), lambda i: round(greatest(0.0, least(1.0, (coalesce(vs[i], 0.0) + 0.0005) * 1000.0)) * 1000.0)::INT), ',') as cells from v")
def sentence_matrix_fixed(spark, sf_dir):
    """Matrices of the first words' vectors under a given vocabulary, saved and loaded; unknown words, padding and clamping included."""
    items, path = kept_titles(spark, sf_dir), scratch(spark, "fixed-vectors")
    enc.save_word_vectors(_fixed_vectors(items), path)
    found = enc.sentence_matrix(items, enc.load_word_vectors(spark, path), 4)
    return found.select("id", F.array_join(F.transform("matrix", lambda v: F.round(v * 1000).cast("int").cast("string")), ",").alias("cells"))


@query(f"with {_TITLES}, v as (select id, list_transform(tokens, lambda w: {_VECTOR}) as vs from t), m as (select id, list_transform(range(1, 5), lambda k: list_avg(list_transform(vs, lambda x: x[k]))) as mean from v) select id, i::INT as i, round(greatest(-1.0, least(1.0, (mean[i % 4 + 1] + 0.0005) * 2000.0 - 1.0)), 6) as x from m, range(0, 10) r(i)")
def mean_vector_fixed(spark, sf_dir):
    """Mean vectors of titles under a given vocabulary, resized from four to ten components."""
    items = kept_titles(spark, sf_dir)
    found = enc.mean_vector(items, _fixed_vectors(items), 4, 10)
    return found.select("id", F.posexplode("vec").alias("i", "x")).select("id", "i", F.round("x", 6).alias("x"))


@query(f"with {_TITLES}, w as (select id, unnest(tokens) as w, generate_subscripts(tokens, 1) as p from t) select id, (p - 1)::INT as place, array_to_string(list_transform({_VECTOR}, lambda x: round(x * 1000000)::INT), ',') as vec from w")
def word_vector_lookup(spark, sf_dir):
    """The vector of every word of a title, and that of unknown words."""
    items = kept_titles(spark, sf_dir)
    placed = enc._vectors(items, _fixed_vectors(items), 4, None)
    return placed.select("id", "place", F.array_join(F.transform("vec", lambda x: F.round(x * 1_000_000).cast("int").cast("string")), ",").alias("vec"))


@query()
def doc_vectors(spark, sf_dir):
    """Vectors of whole titles from a model fitted on all of them, saved and loaded, inferred again."""
    items, path = kept_titles(spark, sf_dir), scratch(spark, "doc-vectors")
    DocVectors.fit(items, size=16, epochs=8).save(path)
    found = DocVectors.load(spark, path).vectors(items)
    return found.select("id", F.array_join(F.transform("vec", lambda v: F.round(v.cast("double"), 5).cast("string")), " ").alias("vec"))


@query()
def doc_vector_neighbours(spark, sf_dir):
    """How often the nearest title, by the vectors of the fit, has the language of the one that asks, and how often by chance,
    over all titles."""
    items = kept_titles(spark, sf_dir)
    fitted = DocVectors.fit(items, size=16, epochs=12).fitted
    return neighbour_share(fitted, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic")), every=1)


@query(f"with {_TITLES}, w as (select unnest(tokens) as word from t), v as (select word from w group by word having count(*) >= 2), u as (select id, unnest(tokens) as word from t) select id, 256 as cells, count(v.word)::INT as known from u left join v using (word) group by id")
def word_vector_sentences(spark, sf_dir):
    """Word vectors learned from titles, saved and loaded; the size of each title's matrix, and its words with a vector."""
    items, path = kept_titles(spark, sf_dir), scratch(spark, "word-vectors")
    enc.save_word_vectors(enc.train_word_vectors(items.select(F.col("tokens").alias("words")), size=16, min_count=2), path)
    vectors_ = enc.load_word_vectors(spark, path)
    known = items.select("id", F.explode("tokens").alias("word")).join(vectors_, "word", "left").groupBy("id").agg(F.count("vec").cast("int").alias("known"))
    return enc.sentence_matrix(items, vectors_, 16).select("id", F.size("matrix").alias("cells")).join(known, "id")


@query("select count(*) as n_rows, 64 as width from embeddings")
def projector_files(spark, sf_dir):
    """Vectors and their labels as tab-separated tables, read back."""
    path = scratch(spark, "projector")
    rows = table(spark, sf_dir, "embeddings")
    sinks.write_projector(rows, path, F.col("embedding"), F.col("vec_id").alias("ID"), F.col("label").cast("string").alias("Title"))
    vecs = spark.read.text(f"{path}/vecs").select(F.size(F.split("value", "\t")).alias("width"))
    return vecs.groupBy("width").agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", "width")


@query("select event_type as name, (user_id % 5)::INT as epoch, round(avg(value), 6) as value from events group by 1, 2")
def mean_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 5).cast("int").alias("epoch"), "value")
    return sinks.mean_metrics(rows).select("name", "epoch", F.round("value", 6).alias("value"))


@query(f"with {_TITLES} select count(*) as index_size from t")
def streamed_index_size(spark, sf_dir):
    """documents as a stream of posts, indexed in micro-batches."""
    docs = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parque[t]")
    path = scratch(spark, "streamed-index")
    ingest.index_stream(ingest.title_stream(stream, "doc_id", "text"), f"{path}/signatures", f"{path}/progress").awaitTermination()
    return ingest.streamed_index(spark, f"{path}/signatures").size()


@query("select time_bucket(interval '1 hour', ts)::VARCHAR as hour, event_type as word, count(*) as n from events group by 1, 2")
def events_by_hour(spark, sf_dir):
    """The windowed count that a stream keeps, over the whole table."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("word"))
    counted = ingest.word_counts(rows)
    return counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "word", "n")
