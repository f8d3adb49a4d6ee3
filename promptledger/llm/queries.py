"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import exact_topk, hashed_ann, html_main, jaccard, merkle, mixing, phrases, sentencepiece, sharding, token_counts, toxicity, vectors
from promptledger.llm import line_dedup as lines
from promptledger.llm import warc as warc_files
from promptledger.llm.common import text_or_empty, word_count

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def prepared(spark: SparkSession) -> SparkSession:
    """Pin the time zone, and let Python workers that start elsewhere import this package from the driver's path."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))
    return spark


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepared(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights repeat over the sources; the mix takes 150 % of all words and no source more than twice.
MIX_WEIGHTS, MIX_SHARE, MIX_REPEATS = (5, 2, 1), 1.5, 2


@query("op2_mix_sources", r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
  from d group by source),
level as (
  select *, 1.5 * sum(source_size) over () as total,
    coalesce(sum(2.0 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as weights
  from s),
goal as (
  select source, source_size, least(2.0 * source_size, weight * max((total - capped) / weights) over ())::double as target from level),
wanted as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from goal),
ranked as (
  select d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size as rest,
    sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, d.h) as same
  from d join wanted w on d.source is not distinct from w.source)
select doc_id, cast(size as bigint) as size, source_size, round(target, 6) as target,
  cast(size * (whole + case when 2 * upto - same < 2 * rest then 1 else 0 end) as bigint) as taken
from ranked
""")
def mix_sources(spark, sf_dir):
    """All documents mixed to 150 % of their words by weights 5, 2, 1."""
    rows = mixing.sized(table(spark, sf_dir, "documents"), word_count(F.col("text")))
    return mixing.mix(rows, MIX_WEIGHTS, {"mix": MIX_SHARE}, MIX_REPEATS).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


SHARDS = 16


@query("op4_interleave", r"""
with recursive bits as (
  select i::ubigint as i, i::ubigint as c, 0 as k from range(256) t(i)
  union all
  select i, xor(c >> 1, (c & 1) * 3988292384::ubigint), k + 1 from bits where k < 8),
crc_table as (select list(c order by i) as t from bits where k = 8),
d as (
  select doc_id, source, coalesce(octet_length(encode(text)), 0) + 1 as size, text,
    cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h,
    cast('0x' || substr(md5(coalesce(source, '')), 1, 8) as bigint)::double / 4294967296.0 as start
  from documents),
f as (
  select *, (row_number() over (partition by source order by h, doc_id) - 1 + start) / count(*) over (partition by source) as fraction from d),
p as (
  select *, row_number() over (order by fraction, source nulls last, h, doc_id) - 1 as place, count(*) over () as total from f),
texts as (select distinct text from documents where text is not null),
crc as (
  select text, xor(4294967295::ubigint, list_reduce(
    list_prepend(4294967295::ubigint, list_transform(range(octet_length(encode(text))), lambda k: cast('0x' || substr(hex(encode(text)), (2 * k + 1)::bigint, 2) as ubigint))),
    lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as bigint) + 1]))) as crc
  from texts, crc_table)
select p.doc_id, cast(p.size as bigint) as size, cast(crc.crc as bigint) as text_crc32, 'rows' as law, cast(place * 16 // total as integer) as shard,
  cast(place - ((place * 16 // total) * total + 15) // 16 as bigint) as slot, cast(null as integer) as grown_shard
from p left join crc on p.text = crc.text
""")
def interleave(spark, sf_dir):
    """All documents in 16 shards of equal row counts, each with the mixture of all sources."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source",
        (F.octet_length(text_or_empty(text)) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.interleave(docs, SHARDS, carry=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op1_sentencepiece")
def encode_decode(spark, sf_dir):
    """Piece ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece.round_trip(docs).select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


#: Rows with this remainder of their id's checksum are held out of training.
HELD_OUT_OF, HELD_OUT_REST = 3, 1
TOXIC_FROM = 0.7


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT_REST, F.lit(False))


@query("op9_toxicity")
def score_toxicity(spark, sf_dir):
    """Toxicity score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


@query("op3_warc", """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
q as (select *, max(page_id) over (partition by d) as last from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 1000 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id is distinct from last then last end as refers_to
from q
""")
def warc(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc_files.round_trip(pages, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_line_dedup", r"""
with l as (
  select doc_id, no, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) as line from (
    select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from documents)),
n as (
  select doc_id, no, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w, row_number() over (partition by doc_id order by no) as pos
  from l where line <> ''),
c as (select *, sum(w) over (partition by doc_id order by pos) as e from n),
runs as (
  select a.doc_id, a.pos as a, min(b.pos) as b from c a join c b on a.doc_id = b.doc_id and b.pos between a.pos and a.pos + 50 and b.e - (a.e - a.w) >= 50 group by all
  union
  select b.doc_id, max(a.pos) as a, b.pos as b from c a join c b on a.doc_id = b.doc_id and a.pos between b.pos - 50 and b.pos and b.e - (a.e - a.w) >= 50 group by b.doc_id, b.pos),
filled as (
  select r.doc_id, r.a, r.b, string_agg(c.line, chr(10) order by c.pos) as content
  from runs r join c on c.doc_id = r.doc_id and c.pos between r.a and r.b group by all),
later as (
  select * from filled qualify row_number() over (partition by content order by doc_id, a) > 1),
gone as (
  select distinct c.doc_id, c.no from c join later r on c.doc_id = r.doc_id and c.pos between r.a and r.b),
texts as (
  select l0.doc_id, string_agg(l0.line, chr(10) order by l0.no) as text, count(*) as kept
  from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as no from documents) l0
  anti join gone g on l0.doc_id = g.doc_id and l0.no = g.no group by l0.doc_id),
counts as (select doc_id, count(*) as n_removed from gone group by doc_id)
select d.doc_id, case when k.n_removed is null then d.text when regexp_matches(coalesce(t.text, ''), '[^\s]') then t.text else '' end as text,
  coalesce(k.n_removed, 0) as n_removed
from documents d left join texts t on d.doc_id = t.doc_id left join counts k on d.doc_id = k.doc_id
""")
def line_dedup(spark, sf_dir):
    """Every text without its later copies of line runs of 50 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, removed="n_removed").select("doc_id", "text", "n_removed")


@query("op5_near_duplicates", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
t as (
  select distinct doc_id, array_to_string(words[i:i + 3], ' ') as shingle from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from t group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from t a join t b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select p.a, p.b from pairs p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 85 * (x.n + y.n - p.k)),
reach as (select doc_id as a, doc_id as b from w union select r.a, l.b from reach r join links l on r.b = l.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from reach where a = w.doc_id) as component_id
from w left join n on n.doc_id = w.doc_id
""")
def near_duplicates(spark, sf_dir):
    """Classes of documents whose sets of four-word shingles have a Jaccard similarity of at least 0.85."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, numerator=85, denominator=100)


@query("op7_nearest")
def nearest(spark, sf_dir):
    """The 20 nearest found, by inner product, of every 20th vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hashed_ann.search(rows, F.col("vec_id") % 20 == 0, k=20)


@query("op8_exact_topk", """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: isfinite(x)))),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.v::double[], b.v::double[])::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
""")
def exact_topk_of_scaled(spark, sf_dir):
    """The 5 highest integer inner products of every 50th vector, components scaled by 256."""
    # Whole numbers as doubles, which no component overflows; floor() itself would give a long.
    scaled = F.transform("embedding", lambda x: vectors.whole(F.lit(256.0) * x.cast("double")))
    return exact_topk.search(table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v")), F.col("vec_id") % 50 == 0, k=5)


@query("op6_html_main_text")
def html_main_text(spark, sf_dir):
    """Main text of every page, by the templates of its host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_main.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Rows whose id's checksum this divides are found changed when the manifest is checked.
CHANGED_OF = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op11_merkle_manifest", r"""
with recursive bits as (
  select i::ubigint as i, i::ubigint as c, 0 as k from range(256) t(i)
  union all
  select i, xor(c >> 1, (c & 1) * 3988292384::ubigint), k + 1 from bits where k < 8),
crc_table as (select list(c order by i) as t from bits where k = 8),
x as (
  select doc_id, source, lang, n_chars, text, case when crc % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as seen
  from (
    select *, xor(4294967295::ubigint, list_reduce(
      list_prepend(4294967295::ubigint, list_transform(range(length(doc_id::varchar)), lambda k: ascii(substr(doc_id::varchar, (k + 1)::bigint, 1))::ubigint)),
      lambda a, b: xor(a >> 8, t[cast(xor(a, b) & 255 as bigint) + 1]))) as crc
    from documents, crc_table) y),
head as (
  select *, coalesce(octet_length(encode(doc_id::varchar)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::varchar)) || ':' || n_chars, '-') as fields from x),
hashed as (
  select doc_id, source, sha256(fields || coalesce(octet_length(encode(text)) || ':' || text, '-')) as leaf,
    sha256(fields || coalesce(octet_length(encode(seen)) || ':' || seen, '-')) as found from head),
sources as (select source, row_number() over (order by source nulls first) - 1 as tree, count(*) as n from hashed group by source),
leaves as (
  select h.*, s.tree, s.n, row_number() over (partition by s.tree order by doc_id nulls first, leaf) - 1 as pos
  from hashed h join sources s on h.source is not distinct from s.source),
low as (
  select 0 as level, tree, n, pos, leaf as digest from leaves
  union all
  select level + 1, tree, (n + 15) // 16, pos // 16, sha256(string_agg(digest, '' order by pos)) from low where n > 1 group by level, tree, n, pos // 16),
subroots as (select tree, digest as subroot from low where n = 1),
high as (
  select 0 as level, (select count(*) from sources) as n, tree as pos, subroot as digest from subroots
  union all
  select level + 1, (n + 15) // 16, pos // 16, sha256(string_agg(digest, '' order by pos)) from high where n > 1 group by level, n, pos // 16),
way as (
  select l.tree, l.pos as leaf_at, k.level, k.pos, k.digest, k.pos < l.pos // (16::bigint ** k.level)::bigint as before, k.pos = l.pos // (16::bigint ** k.level)::bigint as self
  from leaves l join low k on k.tree = l.tree and k.n > 1 and k.pos // 16 = l.pos // (16::bigint ** (k.level + 1))::bigint
  union all
  select l.tree, l.pos, 100 + k.level, k.pos, k.digest, k.pos < l.tree // (16::bigint ** k.level)::bigint, k.pos = l.tree // (16::bigint ** k.level)::bigint
  from leaves l join high k on k.n > 1 and k.pos // 16 = l.tree // (16::bigint ** (k.level + 1))::bigint),
steps as (
  select tree, leaf_at, row_number() over (partition by tree, leaf_at order by level) as step,
    coalesce(string_agg(digest, '' order by pos) filter (not self and before), '') as lefts, coalesce(string_agg(digest, '' order by pos) filter (not self and not before), '') as rights
  from way group by tree, leaf_at, level),
proofs as (select tree, leaf_at, sha256(string_agg(lefts || rights, '' order by step)) as proof, max(step) as last from steps group by all),
folds as (
  select tree, pos, 0 as step, found as digest from leaves
  union all
  select f.tree, f.pos, f.step + 1, sha256(s.lefts || f.digest || s.rights) from folds f join steps s on s.tree = f.tree and s.leaf_at = f.pos and s.step = f.step + 1)
select l.doc_id, l.leaf, u.subroot, h.digest as root, coalesce(p.proof, sha256('')) as proof_sha256, f.digest as folded_root, f.digest = h.digest as verified
from leaves l join subroots u on u.tree = l.tree join high h on h.n = 1
left join proofs p on p.tree = l.tree and p.leaf_at = l.pos
join folds f on f.tree = l.tree and f.pos = l.pos and f.step = coalesce(p.last, 0)
""")
def merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and whether the text as found still leads to the root."""
    text = F.col("text")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % CHANGED_OF == 0
    found = F.when(changed, F.translate(text, _UPPER, _LOWER)).otherwise(text)
    return merkle.manifest(table(spark, sf_dir, "documents"), found).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_collocations", r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^ 	]+') as ws from p),
sizes as (select lang, sum(len(ws))::hugeint as n from w group by lang),
f as (
  select lang, k, ws[i:i + k - 1] as words, count(*)::hugeint as f
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) ks) x group by all),
c as (select * from f where k > 1 and f >= 100),
cuts as (
  select c.lang, c.words, c.k, c.f as a, x.f as l, y.f as r, c.j, 1000 * c.f * s.n // (x.f * y.f) as score
  from (select *, unnest(range(1, k)) as j from c) c join sizes s on s.lang = c.lang
  join f x on x.lang = c.lang and x.words = c.words[1:c.j] join f y on y.lang = c.lang and y.words = c.words[c.j + 1:c.k]),
worst as (select * from cuts qualify row_number() over (partition by lang, words order by score, j) = 1),
inner_parts as (
  select lang, words[i:i + m - 1] as words, max(f) as f
  from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from c) a) b group by all),
kept as (select w.* from worst w anti join inner_parts i on i.lang = w.lang and i.words = w.words and 100 * i.f >= 100 * w.a),
ranked as (
  select k.lang, row_number() over (partition by k.lang order by score desc, a desc, array_to_string(words, ' ')) as rank, array_to_string(words, ' ') as phrase, a, l, r, s.n, score
  from kept k join sizes s on s.lang = k.lang)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
""")
def collocations(spark, sf_dir):
    """The 2,000 strongest phrases of two to five words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


#: Documents of more tokens don't fit into one window.
TOKEN_LIMIT = 1024


@query("op13_token_counts")
def count_tokens(spark, sf_dir):
    """Bytes and tokens of every whole text. ``spark.promptledger.tokenCache`` may name a lasting cache folder; else one is made for the run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, spark.conf.get("spark.promptledger.tokenCache", None), token_counts.default_tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
