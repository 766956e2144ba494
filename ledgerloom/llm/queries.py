"""The numbered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, conversations, langid, merkle, mixing, packing, quality, simhash, tokenfiles, toxicity, urls, vectors
from ledgerloom.llm.labels import labelled_sample
from ledgerloom.session import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3, bits=64, max_bits=2)


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    return vectors.multi_index_search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every 100th vector."""
    return vectors.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


#: The rules of the query: host, path, action.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), rules)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, lengths and checksums of all documents, from token files read back."""
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    root = new_path(spark, "tokens")
    files = tokenfiles.write_token_files(_table(spark, sf_dir, "documents"), tokenizer, root, end_id=2)
    found = tokenfiles.read_token_files(spark, root, files)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def fold(n: int):
    """crc32 of the id as text, modulo n; rows without an id are in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def train_quality(spark: SparkSession, sf_dir: str, documents: DataFrame) -> quality.Model | None:
    """Model from labelled rows outside the held-out fold."""
    most = {0: quality.LABELLED, 1: quality.LABELLED}
    return quality.train(labelled_sample(documents, _table(spark, sf_dir, "labels"), "quality", fold(5) != 0, most))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, train_quality(spark, sf_dir, docs))
    held_out = F.coalesce(fold(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def train_toxicity(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Model | None:
    """Model from labelled rows outside the held-out fold."""
    most = {0: toxicity.OTHER, 1: toxicity.TOXIC}
    return toxicity.train(labelled_sample(documents, _table(spark, sf_dir, "labels"), "toxic", fold(3) != 1, most))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score_documents(docs, train_toxicity(spark, sf_dir, docs))
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold(3) != 1), F.col("lang"))
    return langid.predict(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def rank_file() -> bytes:
    """The content of the public rank file, about 0.8 MB."""
    return Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    ranks = rank_file()
    encoded = bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, by_units=True)
    decoded = bpe.decode_documents(encoded, ranks)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    pieces = packing.cut_documents(_table(spark, sf_dir, "documents"), tokenizer, capacity=1024, end_id=2)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack_pieces(digests, capacity=1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the faults of the query: by a hash of each row's id and turn, a row is lost or changed."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fault, role, text = F.crc32(name.cast("binary")) % 20, F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.where(fault != 0).select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    rows = _table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(rows))
    digests = conversations.conversation_digests(found.rows)
    every = rows.select("conv_id").distinct()
    audits, digests = (d.withColumnRenamed("conv_id", "_id") for d in (found.audits, digests))
    told = every.join(audits, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id").join(digests, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return told.select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and whether a tampered copy still verifies."""
    docs = _table(spark, sf_dir, "documents")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = merkle.digest(*[merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    lowered = merkle.digest(*[merkle.field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], merkle.field(F.translate("text", upper, upper.lower())))
    held = docs.select("doc_id", "lang", leaf.alias("leaf"), F.when(fold(3) == 0, lowered).otherwise(leaf).alias("copy"))
    proven = merkle.manifest(held, "lang", ["doc_id"]).withColumn("folded_root", merkle.folded(F.col("copy"), F.col("path")))
    verified = F.col("folded_root") == F.col("root")
    return proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", verified.alias("verified"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_multi_index": op3_multi_index,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_toxicity": op5_toxicity,
    "op6_url_filters": op6_url_filters,
    "op7_mixing": op7_mixing,
    "op8_token_files": op8_token_files,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_best_fit": op11_best_fit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_OP4 = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as vec
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.vec, v.vec), lambda p: p[1] * p[2])) as bigint) as score
  from usable q join usable v on v.vec_id <> q.vec_id
  where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""

_OP6 = """
with parsed as (
  select page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), judged as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
  end as rule
  from parsed
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""

_OP7 = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size
  from documents
), totals as (
  select cast(coalesce(sum(size), 0) as bigint) as total, count(*) as n_rows from sized
), how as (
  select least(64, greatest(1, total // 1048576)) as block,
         greatest(1, (total + 4194303) // 4194304, (n_rows + 4194303) // 4194304) as shards, total
  from totals
), sizes as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as n
  from sized group by source
), weighed as (
  select *, case n % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         3 * source_size as most
  from sizes
), levels as (
  select *, ((select total from how) - coalesce(sum(most) over (order by most / weight, n rows between unbounded preceding and 1 preceding), 0))::double
         / sum(weight) over (order by most / weight, n rows between current row and unbounded following) as level
  from weighed
), targets as (
  select source, n, source_size,
         least(weight * (select max(level) from levels where level * weight <= most), most::double) as target
  from levels
), dealt as (
  select *, ('0x' || substr(mark, 1, 8))::bigint % (select shards from how) as shard
  from (select *, md5(concat_ws('|', '42', coalesce(cast(doc_id as varchar), 'size' || size))) as mark from sized)
), cells as (
  select d.shard, d.source, t.n, t.source_size, t.target, cast(sum(d.size) as bigint) as cell_size
  from dealt d join targets t on d.source is not distinct from t.source
  group by all
), aimed as (
  select *, case when source_size > 0 then target * cell_size / source_size else 0 end as aim,
         (cell_size + (select block from how) - 1) // (select block from how) as n_blocks
  from cells
), seats as (
  select shard, floor(sum(aim) / (select block from how) + 0.5) as seats from aimed group by shard
), quotients as (
  select shard, n, row_number() over (partition by shard order by aim / (2 * k + 1) desc, n) as place
  from (select shard, n, aim, unnest(range(0, cast(3 * n_blocks as bigint))) as k from aimed)
), quotas as (
  select a.*, (select count(*) from quotients q join seats s using (shard)
               where q.shard = a.shard and q.n = a.n and q.place <= s.seats) as quota
  from aimed a
), runs as (
  select *, case when n_blocks > 0 then quota // n_blocks else 0 end as passes,
         case when n_blocks > 0
              then ('0x' || substr(md5(concat_ws('|', '42run', cast(shard as varchar), coalesce(source, ''))), 1, 8))::bigint % n_blocks
              else 0 end as first
  from quotas
), placed as (
  select *, sum(size) over (partition by shard, source order by mark, doc_id, size
                            rows between unbounded preceding and current row) as hi
  from dealt
), met as (
  select p.doc_id, p.size, r.source_size, r.target, r.passes, p.hi - p.size as lo, p.hi,
         r.first, r.first + r.quota - r.passes * r.n_blocks as until, r.n_blocks, (select block from how) as block
  from placed p join runs r on p.shard = r.shard and p.source is not distinct from r.source
)
select doc_id, size, source_size, target,
       cast(passes * size
            + greatest(least(hi, least(until, n_blocks) * block) - greatest(lo, first * block), 0)
            + case when until > n_blocks then greatest(least(hi, (until - n_blocks) * block) - lo, 0) else 0 end as bigint) as taken
from met
"""

#: CRC-32 of ASCII digits, bit by bit, as DuckDB has no function for it.
def _crc(text: str) -> str:
    return f"""xor(list_reduce(
      list_concat([4294967295::ubigint], list_transform(string_split({text}, ''), lambda c: ascii(c)::ubigint)),
      lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)::ubigint[]), lambda x, i: xor(x >> 1, 3988292384::ubigint * (x & 1::ubigint)))),
    4294967295::ubigint)"""


#: The least cost and audit of each state after each row, in one recursion over the rows.
_OP12 = rf"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_crc("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as fault
  from conversations
), damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when fault = 3 then 2 else 1 end)) as copy
  from named where fault <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as place from damaged
), judged as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by place) > 1 then 'duplicate'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault,
         lag(role[1]) over (partition by conv_id order by place) || role[1] as pair
  from placed
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from judged group by conv_id
), gives(state, role, target) as (
  values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), keeps(state, initial, target) as (
  values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts as (
  select state, 0 as more, '' as edits, '' as lines, state as target from gives
  union all select state, 5, 'I', role || ':' || chr(10), target from gives
  union all select a.state, 10, 'II', a.role || ':' || chr(10) || b.role || ':' || chr(10), b.target from gives a join gives b on b.state = a.target
), edits as (
  select j.conv_id, j.place, i.state, i.more + e.cost as cost, i.edits || e.edit as edit, i.lines || e.line as line, e.target
  from judged j cross join inserts i join lateral (
    select i.target as target, 2 as cost, 'D' as edit, '' as line
    union all select g.target, 1 + case j.fault when 'truncated' then 5 else 0 end, 'R', g.role || ':' || j.text || chr(10)
      from gives g where g.state = i.target and j.fault not in ('blank', 'duplicate')
    union all select k.target, case j.fault when 'truncated' then 5 else 0 end, 'K', j.role || ':' || j.text || chr(10)
      from keeps k where k.state = i.target and k.initial = j.role[1] and j.fault not in ('blank', 'duplicate')
  ) e on true
), best as (
  select conv_id, 0 as place, 0 as state, {{'cost': 0, 'audit': '', 'lines': ''}} as way from facts
  union all
  select b.conv_id, b.place + 1, e.target, min({{'cost': b.way.cost + e.cost, 'audit': b.way.audit || e.edit, 'lines': b.way.lines || e.line}})
  from best b join edits e on e.conv_id is not distinct from b.conv_id and e.place = b.place + 1 and e.state = b.state
  group by b.conv_id, b.place + 1, e.target
), ended as (
  select f.conv_id, min({{'cost': b.way.cost + i.more, 'audit': b.way.audit || i.edits, 'lines': b.way.lines || i.lines}}) as way
  from facts f join best b on f.conv_id is not distinct from b.conv_id and b.place = f.n join inserts i on i.state = b.state
  where i.target in (0, 3) group by f.conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(way.cost, 0)::bigint as cost, coalesce(way.audit, '') as audit,
       sha256(coalesce(way.lines[:-2], '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts f on c.conv_id is not distinct from f.conv_id left join ended e on c.conv_id is not distinct from e.conv_id
"""

_HELD = ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)"))

_OP13 = f"""
with recursive held as (
  select doc_id, lang, sha256(concat({_HELD}, coalesce(strlen(text) || ':' || text, '-'))) as leaf,
         case when ({_crc('cast(doc_id as varchar)')}) % 3 = 0
              then sha256(concat({_HELD}, coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')))
              else sha256(concat({_HELD}, coalesce(strlen(text) || ':' || text, '-'))) end as copy
  from documents
), leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by lang) as n from held
), nodes as (
  select 0 as level, lang, place, n, leaf as digest from leaves
  union all
  select level + 1, lang, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by place))
  from nodes where n > 1 group by level, lang, place // 8
), subroots as (
  select lang, digest, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from nodes where n = 1
), above as (
  select 0 as level, place, n, digest from subroots
  union all
  select level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' order by place))
  from above where n > 1 group by level, place // 8
), path_entries as (
  select a.level, a.lang, a.place,
         coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as before,
         coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as after
  from nodes a join nodes b on a.level = b.level and a.lang is not distinct from b.lang and a.place // 8 = b.place // 8
  where a.n > 1 group by a.level, a.lang, a.place
), above_entries as (
  select a.level, a.place,
         coalesce(string_agg(b.digest, '' order by b.place) filter (b.place < a.place), '') as before,
         coalesce(string_agg(b.digest, '' order by b.place) filter (b.place > a.place), '') as after
  from above a join above b on a.level = b.level and a.place // 8 = b.place // 8
  where a.n > 1 group by a.level, a.place
), walk as (
  select doc_id, lang, leaf, place, place as at, n, 0 as level, copy as folded, '' as proof from leaves
  union all
  select w.doc_id, w.lang, w.leaf, w.place, w.at // 8, (w.n + 7) // 8, w.level + 1, sha256(e.before || w.folded || e.after), w.proof || e.before || e.after
  from walk w join path_entries e on e.level = w.level and e.lang is not distinct from w.lang and e.place = w.at
  where w.n > 1
), top as (
  select w.doc_id, w.leaf, w.place, w.lang, s.digest as subroot, s.place as at, s.n, 0 as level, w.folded, w.proof
  from walk w join subroots s on w.lang is not distinct from s.lang where w.n = 1
), climb as (
  select * from top
  union all
  select c.doc_id, c.leaf, c.place, c.lang, c.subroot, c.at // 8, (c.n + 7) // 8, c.level + 1, sha256(e.before || c.folded || e.after), c.proof || e.before || e.after
  from climb c join above_entries e on e.level = c.level and e.place = c.at
  where c.n > 1
)
select doc_id, leaf, subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.digest as verified
from climb, (select digest from above where n = 1) r
where n = 1
"""

ORACLE_SQL: dict[str, str] = {"op12_conversation_repair": _OP12, "op13_merkle_manifest": _OP13, "op4_exact_top_k": _OP4, "op6_url_filters": _OP6, "op7_mixing": _OP7}
