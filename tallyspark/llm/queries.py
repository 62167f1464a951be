"""Registered queries of the training-data operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.ann import nearest_neighbours
from tallyspark.llm.bestfit import pack_best_fit
from tallyspark.llm.fingerprints import CHECK, GROUP_BIT, LOAD, PRIME, ROWS, WIDTH, fingerprint_documents
from tallyspark.llm.langid import held_out, identify_language
from tallyspark.llm.licenses import TEMPLATES, THRESHOLD, scan_licenses
from tallyspark.llm.mixing import BLOCK_TOKENS, REPEAT_LIMIT, mix_sources
from tallyspark.llm.neardup import near_duplicates
from tallyspark.llm.negatives import mine_negatives
from tallyspark.llm.packing import pack_documents
from tallyspark.llm.pii import BASE, find_personal_data
from tallyspark.llm.runs import periodic_runs
from tallyspark.llm.sharding import BITS, SHARD_BYTES, shard_documents
from tallyspark.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, neighbours by BM25."""
    pieces = pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
                        joined("spans").alias("spans"))


@query
def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    found = identify_language(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op8_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc_dictionary"] = """
with p as (select page_id, coalesce(html, '') as payload from pages),
g as (select payload, max(page_id) as response from p group by payload),
h as (select page_id, response, octet_length(encode(p.payload)) as payload_bytes, sha1(p.payload) as hex
      from p join g on p.payload = g.payload),
d as (select *, list_transform(range(8), lambda i: cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as bigint)) as fives from h)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       array_to_string(list_transform(fives, lambda v:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 32768 + 1 as int), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 1024 % 32 + 1 as int), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v // 32 % 32 + 1 as int), 1)
           || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(v % 32 + 1 as int), 1)), '') as payload_digest,
       case when page_id = response then 'response' else 'revisit' end as record_type,
       case when page_id <> response then response end as refers_to
from d
"""


@query
def op10_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def _digests_sql(text: str) -> str:
    return (f"list_distinct(list_transform(list_filter(string_split(regexp_replace({text}, '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)), "
            "lambda p: p <> ''), lambda p: cast('0x' || substr(md5(p), 1, 15) as bigint)))")


def _sketch_sql(digests: str) -> str:
    groups = f"(case when len({digests}) <= {LOAD} then 1 else 1 << len(to_binary((len({digests}) + {LOAD - 1}) // {LOAD} - 1)) end)"
    own = (f"list_filter({digests}, lambda d: (d >> {GROUP_BIT}) % {groups} = i // {ROWS * WIDTH} "
           f"and (d >> (2 * (i % {ROWS * WIDTH} // {WIDTH}))) & {WIDTH - 1} = i % {WIDTH})")
    check = f"xor((d % {CHECK}) << 29, d % {PRIME})"
    return (f"array_to_string(list_transform(list_transform(range({groups} * {ROWS * WIDTH}), lambda i: {own}), lambda own: "
            "case when len(own) = 0 then '' else concat_ws('.', len(own), lower(to_hex(list_aggregate(own, 'bit_xor'))), "
            f"lower(to_hex(list_aggregate(list_transform(own, lambda d: {check}), 'bit_xor')))) end), '|')")


ORACLES["op10_invertible_sketch"] = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, text, length(text) as n, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as next
      from t),
e as (select *, substr(text, 1, n - n // 4) || substr(next, 1, n // 4) as edited from n),
d as (select doc_id, n, sha256(edited) as sha, {_digests_sql("text")} as a, {_digests_sql("edited")} as b,
             {_digests_sql("next")} as c from e),
s as (select *, len(list_intersect(a, b)) as ab, len(list_intersect(a, c)) as ac from d)
select doc_id, cast(n as bigint) as n_chars, sha as edited_sha256, {_sketch_sql("a")} as fingerprint,
       {_sketch_sql("b")} as edited_fingerprint,
       case when len(a) + len(b) = 0 then 1.0 else cast(ab as double) / (len(a) + len(b) - ab) end as near_edited,
       case when len(a) + len(c) = 0 then 1.0 else cast(ac as double) / (len(a) + len(c) - ac) end as near_next
from s
"""


@query
def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 9).alias("weight"),
                        F.col("mix_rate").alias("rate"), F.col("mix_block").alias("block"), F.col("mix_copies").alias("copies"))


ORACLES["op6_temperature_mixing"] = f"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 as tokens,
         cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as draw
  from documents),
s as (select source, cast(sum(tokens) as bigint) as tokens from d group by source),
t as (select cast(sum(tokens) as double) as total, cast(min(tokens) as double) as least, cast(max(tokens) as double) as most from s),
bisect(step, low, high) as (
  select 0, 0.0::double, case when pow((least / total) / (most / total), -1.0) > {REPEAT_LIMIT} then 1.0::double else 0.0::double end from t
  union all
  select step + 1, case when flat then (low + high) / 2 else low end, case when flat then high else (low + high) / 2 end
  from (select *, pow((least / total) / (most / total), (low + high) / 2 - 1) > {REPEAT_LIMIT} as flat from bisect, t) where step < 40),
a as (select floor(high * 1e6 + 0.5) / 1e6 as exponent from bisect where step = 40),
z as (select sum(pow(tokens / total, exponent)) as z from s, t, a),
p as (select source, tokens as source_tokens, pow(tokens / total, exponent) / z as weight,
             floor(most / (pow(most / total, exponent) / z) * (pow(tokens / total, exponent) / z) / tokens * 1e9 + 0.5) / 1e9 as rate,
             cast(ceil(tokens / {BLOCK_TOKENS}) as bigint) as blocks
      from s, t, a, z),
r as (select doc_id, d.source, tokens, weight, rate, draw, draw % blocks as block from d join p on d.source is not distinct from p.source),
w as (select *, 2 * sum(tokens) over (partition by source, block order by draw, doc_id, tokens rows unbounded preceding) - tokens as middle,
             sum(tokens) over (partition by source, block) as block_tokens from r)
select doc_id, source, cast(tokens as bigint) as tokens, round(weight, 9) as weight, rate, cast(block as bigint) as block,
       cast(floor(rate) + case when middle <= 2 * (rate - floor(rate)) * block_tokens then 1 else 0 end as bigint) as copies
from w
"""


@query
def op7_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLES["op7_extendible_hashing"] = f"""
with d as (select doc_id, octet_length(encode(coalesce(text, ''))) as bytes,
                  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h from documents),
e as (select *, h >> cast({BITS} - depth as bigint) as prefix from d, (select unnest(range(0, 41)) as depth)),
s as (select depth, prefix, cast(sum(bytes) as bigint) as shard_bytes, count(*) as shard_rows from e group by depth, prefix
      having sum(bytes) <= {SHARD_BYTES} or count(*) = 1),
f as (select e.doc_id, min(e.depth) as depth from e join s on e.depth = s.depth and e.prefix = s.prefix group by e.doc_id)
select e.doc_id, cast(e.bytes as bigint) as bytes, cast(e.depth as int) as depth,
       substr(lpad(to_binary(e.prefix), {BITS}, '0'), cast({BITS} - e.depth + 1 as int)) as shard, shard_bytes, shard_rows
from f join e on f.doc_id = e.doc_id and f.depth = e.depth join s on s.depth = e.depth and s.prefix = e.prefix
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of licences in every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "license", "dice", "first_word", "n_words")


_QUOTED = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))


def _pairs_sql(text: str) -> str:
    lower = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    own = f"list_transform(regexp_extract_all({lower}, '[a-z0-9]+(?:\\.[a-z0-9]+)*'), lambda w: case when w = 'licence' then 'license' else w end)"
    return f"list_transform(list_zip({own}[:-2], {own}[2:]), lambda p: p[1] || ' ' || p[2])"


ORACLES["op9_license_scan"] = f"""
with d as (select row_number() over () as rid, doc_id, {_pairs_sql("coalesce(text, '')")} as pairs from documents),
t as (select *, ceil(size * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9) as need, floor(size * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9) as reach
      from (select *, len(own) as size from (select tid, license, {_pairs_sql("body")} as own from (values {_QUOTED}) as v(tid, license, body)))),
n as (select tid, pair, count(*) as times from (select tid, unnest(own) as pair from t) group by tid, pair),
p as (select rid, unnest(pairs) as pair, unnest(range(len(pairs))) as pos from d),
h as (select rid, tid, pos, pair, times from p join n using (pair)),
f as (select a.rid, a.tid, a.pos as first, b.pos as last from h a join h b on a.rid = b.rid and a.tid = b.tid join t on t.tid = a.tid
      where b.pos - a.pos + 1 between need and reach),
c as (select f.rid, f.tid, first, last, least(count(*), any_value(times)) as held
      from f join h on f.rid = h.rid and f.tid = h.tid and h.pos between first and last group by f.rid, f.tid, first, last, pair),
g as (select rid, tid, first, last, sum(held) as shared from c group by rid, tid, first, last),
s as (select g.*, doc_id, license, size + last - first + 1 as every, 2.0::double * shared / (size + last - first + 1) as dice
      from g join (select rid, doc_id from d) using (rid) join t using (tid)),
b as (select *, row_number() over (partition by rid, tid, first order by dice desc, last desc) as best from s where dice >= {THRESHOLD}),
k as (select rid, doc_id, list([{{'license': license, 'dice': dice, 'first': first, 'last': last}}]
                                order by 4 * shared - every desc, dice desc, first, last, license, tid) as runs from b where best = 1 group by rid, doc_id),
u as (select doc_id, unnest(list_reduce(runs, lambda kept, run: case when len(list_filter(kept, lambda o:
        o['first'] <= run[1]['last'] + 1 and run[1]['first'] <= o['last'] + 1)) = 0 then kept || run else kept end)) as run from k)
select doc_id, run['license'] as license, run['dice'] as dice, cast(run['first'] as bigint) as first_word,
       cast(run['last'] - run['first'] + 2 as bigint) as n_words from u
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of which every tenth, by the checksum of its number, goes on in a period from some word on.

    With h = crc32(doc_id) and g = h div 10, a text of n words with h divisible by 10 keeps its first a + p words, a = g % n and
    p = 1 + (n - a) div (3 + g % 8), and then repeats the last p of them. Other texts, those without words and those without a
    number stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(r):
        at = F.sequence(F.lit(0).cast("long"), r.n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(r.words, F.when(i < r.a, i).otherwise(r.a + (i - r.a) % r.p))), " ")

    # one-row arrays name a value once, so the text is cut once
    one = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n")))
    g = F.floor(h / 10)
    two = F.transform(one, lambda r: F.struct(r.words, r.n, (g % F.greatest(r.n, F.lit(1))).alias("a")))
    three = F.transform(two, lambda r: F.struct(
        r.words, r.n, r.a, (1 + F.floor((r.n - r.a) / (3 + g % 8))).alias("p")))
    text = F.get(F.transform(three, lambda r: F.when(r.n > 0, planted(r)).otherwise(F.col("text"))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of every document."""
    found = periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start, r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in few sequences of 4096 tokens, cut only where longer."""
    pieces = pack_best_fit(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "piece", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels moved on by one where vec_id is divisible by 7."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings"), label=moved)


ORACLES["op13_hard_negatives"] = """
with r as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
             cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
      from r a join r c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score,
             row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (select p.anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
             row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id and not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
      where place <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 10
"""
