"""The queries over the given tables, by name, with SQL that gives the same rows.

``eval_cases`` are the queries and claims, ``index_chunks`` the corpus that is searched, ``documents`` of the source "answer"
the cited answers, ``walked_files`` the tree on disk, ``files`` its recorded state, ``events`` a progress stream. Repeated
rows of index_chunks are folded to one for each chunk_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25, chunking, drift, fusion, graph, grounding, parsing, prompts, store, vectors
from tessera.session import by_key, shared, spread, table, written
from tessera.sources import files as src
from tessera.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2025-06-01 00:00:00"
#: What was indexed before is in the cache of cache_probe.
CACHED_UNTIL = "2025-06-10 00:00:00+00:00"


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- inputs ---------------------------------------------------------------------------------------------------------


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One row for each chunk_id; written once for all queries that read it."""

    def make() -> DataFrame:
        used = ("chunk_id", "repo_id", "file_path", "symbol_name", "signature", "body", "symbol_type", "start_line", "end_line")
        c = by_key(table(spark, d, "index_chunks").where("chunk_id is not null").select(*used), "chunk_id")
        first = lambda x: F.max(x).alias(x)
        return c.groupBy("chunk_id").agg(*map(first, ("repo_id", "file_path", "symbol_name", "signature", "body")), F.max(F.lower(F.trim("symbol_type"))).alias("kind"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))

    return shared(spark, d, "chunks", "index_chunks", make)


CHUNKS = """chunks as (select chunk_id, max(repo_id) repo_id, max(file_path) file_path, max(symbol_name) symbol_name, max(signature) signature,
  max(body) body, max(lower(trim(symbol_type))) kind, min(start_line) start_line, max(end_line) end_line
  from index_chunks where chunk_id is not null group by chunk_id)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(id, text) of the chunks, as they are searched."""
    text = F.concat_ws("\n", F.coalesce("symbol_name", F.lit("")), F.coalesce("signature", F.lit("")), F.coalesce("body", F.lit("")))
    return chunks(spark, d).select(F.col("chunk_id").alias("id"), text.alias("text"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").select(F.col("item_id").alias("query_id"), F.coalesce("query", F.lit("")).alias("text"))


def _tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace({x}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda t: lower(t))"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


PORTABLE_TOKEN = r"[A-Za-z_][\p{L}\p{N}_]*|\p{Nd}+|[^\s\p{Z}\p{L}\p{N}_]"
INDEX = f"""{CHUNKS},
corpus as (select chunk_id id, concat_ws(chr(10), coalesce(symbol_name, ''), coalesce(signature, ''), coalesce(body, '')) text from chunks),
words as materialized (select id, {_tokens('text')} words from corpus),
lengths as (select id, len(words) dl from words),
stats as (select count(*) n_docs, avg(dl) avgdl from lengths),
postings as materialized (select term, id, count(*) tf from (select id, unnest(words) term from words) group by term, id),
raw as (select term, count(*) df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) raw from postings, stats group by term),
terms as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end idf from raw)"""
ASKED = f"""asked as materialized (select item_id query_id, term, count(*) qtf from (select item_id, unnest({_tokens("coalesce(query, '')")}) term from eval_cases) group by 1, 2)"""
SCORED = f"""{INDEX}, {ASKED},
scored as materialized (select query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from asked join postings using (term) join lengths using (id) join terms using (term) cross join stats group by query_id, id),
bm as (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from scored) where rank <= 20 and score > 0)"""


def sha_vector_sql(x: str) -> str:
    return f"list_transform(range(16), lambda i: (('0x' || substr(sha256({x}), (2 * i + 1)::int, 2))::int)::double / 255)"


FUSED = f"""{SCORED},
dv as materialized (select id, {sha_vector_sql('text')} v from corpus),
qv as (select item_id query_id, {sha_vector_sql("coalesce(query, '')")} v from eval_cases),
ds as (select query_id, id, round(list_dot_product(qv.v, dv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(dv.v, dv.v))), 6) score from qv, dv),
dn as (select query_id, id, rank from (select query_id, id, row_number() over (partition by query_id order by score desc, id) rank from ds) where rank <= 20),
lists as (select query_id, id, 0 list_no, rank from dn union all select query_id, id, 1, rank from bm),
fused as materialized (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, list_no, first_rank, id) rank
  from (select query_id, id, round(sum(1.0::double / (60 + rank)), 6) score, min(list_no) list_no, arg_min(rank, list_no) first_rank from lists group by 1, 2)) where rank <= 20)"""
RERANKED = f"""{FUSED},
cand as (select f.query_id, f.id, f.rank, lower(coalesce(e.query, '')) query,
  lower(substr({_strip("concat_ws(' ', coalesce(file_path, ''), coalesce(symbol_name, ''), coalesce(signature, ''))")} || chr(10) || coalesce(body, ''), 1, 2000)) text
  from fused f join chunks c on c.chunk_id = f.id join eval_cases e on e.item_id = f.query_id),
hits as (select query_id, id, rank, coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> ''), lambda w: (length(text) - length(replace(text, w, '')))::double / length(w))), 0) score from cand),
reranked as materialized (select * from (select query_id, id, score, row_number() over (partition by query_id order by score desc, rank) rank from hits) where rank <= 8)"""
EDGES = r"""cont as (select src, arg_min(dst, span || '|' || dst) dst from (
    select s.chunk_id src, c.chunk_id dst, lpad((c.end_line - c.start_line)::varchar, 12, '0') span from chunks s join chunks c on s.file_path = c.file_path
    where c.kind in ('class', 'struct', 'interface', 'impl', 'trait', 'type', 'enum') and c.start_line <= s.start_line and c.end_line >= s.end_line
      and c.end_line - c.start_line > s.end_line - s.start_line and s.chunk_id <> c.chunk_id) group by src),
sites as (select distinct chunk_id src, repo_id, unnest(regexp_extract_all(body, '([A-Za-z_][A-Za-z0-9_]*)!?\(', 1)) name from chunks),
call as (select distinct src, c.chunk_id dst from sites s join chunks c on c.repo_id = s.repo_id and c.symbol_name = s.name where c.kind in ('function', 'method', 'constructor') and src <> c.chunk_id),
named as (select repo_id, symbol_name, max(chunk_id) dst from chunks where kind in ('class', 'struct', 'interface', 'impl', 'trait', 'type', 'enum') group by 1, 2),
recv as (select c.chunk_id src, n.dst from chunks c join named n on n.repo_id = c.repo_id and n.symbol_name = regexp_extract(c.body, '^func \([A-Za-z_][A-Za-z0-9_]* \*?([A-Za-z_][A-Za-z0-9_]*)\)', 1) where c.kind = 'method' and c.chunk_id <> n.dst),
inames as (select chunk_id src, repo_id, array_to_string(list_concat(regexp_extract_all(body, 'IMPORT', 1), regexp_extract_all(body, 'IMPORT', 2), regexp_extract_all(body, 'IMPORT', 3), regexp_extract_all(body, 'IMPORT', 4), regexp_extract_all(body, 'IMPORT', 5)), ' ') t from chunks),
imp as (select distinct src, c.chunk_id dst from (select src, repo_id, unnest(regexp_extract_all(t, '[A-Za-z_]\w*')) name from inames) i join chunks c on c.repo_id = i.repo_id and c.symbol_name = i.name where c.kind in ('function', 'method', 'constructor') and src <> c.chunk_id),
edges as materialized (select src, dst, arg_min(type, p) type from (select src, dst, 'imports' type, 0 p from imp union all select src, dst, 'calls', 1 from call union all select src, dst, 'implements', 2 from cont union all select src, dst, 'implements', 3 from recv) group by 1, 2)""".replace("IMPORT", parsing.IMPORT)


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"select doc_id, len({_tokens('text')}) n_tokens, len(list_distinct({_tokens('text')})) n_distinct from documents where text is not null")
def code_token_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").where("text is not null").select("doc_id", T.code_tokens(F.col("text")).alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"with {CHUNKS} select chunk_id, len(regexp_extract_all(body, '{PORTABLE_TOKEN}')) tokens from chunks")
def approx_token_count(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).select("chunk_id", T.token_count(F.col("body")).cast("long").alias("tokens"))


@query(f"""with s as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda x: {_strip('x')}), lambda x: x <> '') s from documents where text is not null)
select doc_id, unnest(range(len(s))) pos, unnest(s) sentence from s""")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("col").alias("sentence"))


ANSWERS = "answers as (select doc_id answer_id, text from documents where regexp_replace(lower(source), '[\\s_-]+', '', 'g') = 'answer' and text is not null)"
CITED = rf"""{ANSWERS}, found as (select answer_id, text, regexp_extract_all(text, '{T.CITATION}', 1) f, regexp_extract_all(text, '{T.CITATION}', 2) s, regexp_extract_all(text, '{T.CITATION}', 3) e from answers),
flat as (select answer_id, unnest(range(len(f))) n, unnest(f) file, unnest(s)::bigint "start", unnest(list_transform(e, lambda x: coalesce(nullif(x, ''), NULL))) e from found),
spans as (select answer_id, file, "start", coalesce(e::bigint, "start") "end", min(n) n from flat group by 1, 2, 3, 4),
cited as materialized (select answer_id, row_number() over (partition by answer_id order by n) - 1 pos, file, "start", "end" from spans)"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    key = F.regexp_replace(F.lower("source"), r"[\s_-]+", "")
    return docs.where((key == "answer") & F.col("text").isNotNull()).select(F.col("doc_id").alias("answer_id"), "text")


@query(f'with {CITED} select answer_id, pos, file, "start", "end" from cited')
def citations_parsed(spark: SparkSession, d: str) -> DataFrame:
    return grounding.cited(answers(spark, d))


@query("""with c as (select distinct chunk_id, file_path, symbol_name, part, body from index_chunks where chunk_id is not null),
h as (select chunk_id, file_path || '|' || symbol_name || '|' || part || '|' || sha256(body) key from c),
s as (select chunk_id, sha1(unhex('5f3c9a1e2b6d4e8a9c477a1d0b2f6e30') || encode(key)) h from h)
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', ((('0x' || substr(h, 17, 2))::int & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) made from s""")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "index_chunks").where("chunk_id is not null").select("chunk_id", "file_path", "symbol_name", "part", "body").distinct()
    return c.select("chunk_id", T.chunk_id(F.col("file_path"), F.col("symbol_name"), F.col("part"), F.col("body")).alias("made"))


@query(f"""with {CHUNKS}, w as (select chunk_id, list_distinct(list_transform(regexp_extract_all(signature, '{T.IDENTIFIER}'), lambda x: lower(x))) a, list_distinct(list_transform(regexp_extract_all(body, '{T.IDENTIFIER}'), lambda x: lower(x))) b from chunks where signature is not null and body is not null)
select chunk_id, case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end similarity from w""")
def jaccard_similarity(spark: SparkSession, d: str) -> DataFrame:
    """How much of a chunk's words its signature has."""
    c = chunks(spark, d).where("signature is not null and body is not null")
    return c.select("chunk_id", T.jaccard(T.word_set(F.col("signature")), T.word_set(F.col("body"))).alias("similarity"))


@query("""select c_custkey, list_reduce(list_prepend(0::ubigint, list_transform(string_split(c_name, ''), lambda c: ord(c)::ubigint)), lambda h, c: (h * 31 + c) & 4294967295) % 360 as hue from customer""")
def hash_hue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.name_hue(F.col("c_name")).alias("hue"))


@query(f"""select event_id, case when s < 60 then 'just now' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end age
from (select event_id, greatest(0, epoch(timestamp '{NOW}')::bigint - floor(epoch(ts))::bigint) s from events)""")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    return table(spark, d, "events").select("event_id", T.relative_time(F.col("ts").cast("timestamp"), now).alias("age"))


@query("""with k as (select id, case when contains(lower(error), 'not set') then 'llm_unconfigured' when contains(lower(error), 'rate limit') or contains(lower(error), 'rate_limit') or contains(lower(error), '429') then 'rate_limited' else 'llm_error' end kind
from repos where error is not null) select kind, count(distinct id) repos, count(distinct (f.repo_id, f.path)) filter (f.path is not null) files from k left join files f on f.repo_id = k.id group by kind""")
def error_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of failures, with the repositories and files that they concern."""
    k = table(spark, d, "repos").where("error is not null").select("id", T.error_type(F.col("error")).alias("kind"))
    f = table(spark, d, "files").select(F.col("repo_id").alias("id"), "path").distinct().groupBy("id").agg(F.count("path").alias("n"))
    return k.join(f, "id", "left").groupBy("kind").agg(F.count("*").alias("repos"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


# --- sources --------------------------------------------------------------------------------------------------------


# The SQL of these rules has its own values and works on path parts, not on the patterns that the operators compile.
def _language_sql(path: str) -> str:
    end = f"lower(regexp_extract({path}, '[^/]\\.([^./]+)$', 1))"
    return f"""(case when {end} in ('py', 'pyi') then 'python' when {end} = 'go' then 'go' when {end} in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when {end} in ('ts', 'tsx') then 'typescript'
when {end} = 'rs' then 'rust' when {end} in ('c', 'h') then 'c' when {end} in ('cc', 'cpp', 'cxx', 'hpp', 'hh', 'hxx') then 'cpp' when {end} = 'java' then 'java' end)"""


def _ignored_sql(path: str) -> str:
    parts = f"string_split(regexp_replace({path}, '^(\\./|/)+', ''), '/')"
    folders = "'.git', '.idea', '.vscode', 'node_modules', 'vendor', 'third_party', '.venv', 'venv', 'env', 'ENV', 'site-packages', 'dist', 'build', 'target', 'out', '__pycache__', '.mypy_cache', '.ruff_cache', '.pytest_cache'"
    ends = " or ".join(f"ends_with(x, '{e}')" for e in (".gen.go", ".pb.go", ".pb.cc", ".pb.h", "_pb2.py", "_pb2_grpc.py", ".min.js", ".min.css", ".map"))
    return f"""(len(list_filter({parts}[:-2], lambda x: x in ({folders}) or ends_with(x, '.egg-info'))) > 0 or len(list_filter({parts}, lambda x: contains(x, '.generated.') or {ends})) > 0)"""


@query(f"select file_id, {_language_sql('path')} detected from walked_files group by 1, 2")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "walked_files").select("file_id", T.language_of(F.col("path")).alias("detected")).distinct()


@query(f"select file_id, {_ignored_sql('path')} ignored from walked_files group by 1, 2")
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "walked_files").select("file_id", src.is_ignored(F.col("path")).alias("ignored")).distinct()


@query(f"""select distinct file_id, {_language_sql('path')} detected from walked_files
where not {_ignored_sql('path')} and {_language_sql('path')} is not null and content is not null and strlen(content) <= 1000000""")
def eligible_files(spark: SparkSession, d: str) -> DataFrame:
    return src.eligible(table(spark, d, "walked_files")).select("file_id", "detected").distinct()


@query("""with o as (select repo_id, path, max(content_hash) h from files group by 1, 2), n as (select repo_id, path, max(sha256(content)) h from walked_files where content is not null group by 1, 2)
select * from (select coalesce(o.repo_id, n.repo_id) repo_id, coalesce(o.path, n.path) path, case when o.path is null then 'added' when n.path is null then 'removed' when o.h is distinct from n.h then 'modified' end change
from o full join n on o.repo_id = n.repo_id and o.path = n.path) where change is not null""")
def changed_files(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "files").groupBy("repo_id", "path").agg(F.max("content_hash").alias("content_hash"))
    new = table(spark, d, "walked_files").where("content is not null").select("repo_id", "path", F.sha2("content", 256).alias("content_hash"))
    return src.changed(old, new.groupBy("repo_id", "path").agg(F.max("content_hash").alias("content_hash")))


# --- chunking -------------------------------------------------------------------------------------------------------


@query("""with p as (select distinct parsed_id, file_path, symbol_name, body, start_line, end_line from parsed_chunks where parsed_id is not null)
select file_path, symbol_name, start_line, end_line, len(string_split(body, chr(10))) n_lines from p""")
def symbol_spans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_chunks").where("parsed_id is not null").select("parsed_id", "file_path", "symbol_name", "body", "start_line", "end_line").distinct()
    return p.select("file_path", "symbol_name", "start_line", "end_line", F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


@query()
def parse_files(spark: SparkSession, d: str) -> DataFrame:
    """Every file parsed anew; parsed_chunks holds what the reference made of the same files."""
    files = table(spark, d, "walked_files").select("path", "content")
    out = parsing.parse_files(files.distinct())
    return out.select("path", "symbol_name", "symbol_type", "start_line", "end_line")


@query()
def greedy_windows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parsed_chunks").where("parsed_id is not null").select("parsed_id", "file_path", "symbol_name", "body", "start_line").distinct()
    out = chunking.split_symbols(p)
    return out.select("chunk_id", "parsed_id", "start_line", "end_line", "token_count", "part", "part_total")


# --- retrieval ------------------------------------------------------------------------------------------------------


@query(f"with {INDEX} select term, df, round(idf, 6) idf from terms")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _index(spark: SparkSession, d: str) -> bm25.Bm25Index:
    """The inverted index of the chunks, built once for all queries."""
    return bm25.build_index(corpus(spark, d), keep=lambda df, name: shared(spark, d, name, "index_chunks", lambda: df))


def _bm25_leg(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(bm25.scores(_index(spark, d), asked(spark, d)), 20)


def _dense_leg(spark: SparkSession, d: str) -> DataFrame:
    rows = shared(spark, d, "vectors", "index_chunks", lambda: corpus(spark, d).select("id", T.sha_vector(F.col("text")).alias("vector")))
    return vectors.nearest(rows, asked(spark, d).select("query_id", T.sha_vector(F.col("text")).alias("vector")), 20)


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse([_dense_leg(spark, d), _bm25_leg(spark, d)], 20)


@query(f"with {SCORED} select query_id, id, score, rank from bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_leg(spark, d)


@query("""select query_id, id, score, rank from (select q.vec_id query_id, r.vec_id id, round(list_dot_product(q.embedding::double[], r.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(r.embedding::double[], r.embedding::double[]))), 6) score,
row_number() over (partition by q.vec_id order by round(list_dot_product(q.embedding::double[], r.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(r.embedding::double[], r.embedding::double[]))), 6) desc, r.vec_id) rank
from embeddings q, embeddings r where q.vec_id % 20 = 0) where rank <= 10""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.nearest(e, e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query(f"with {FUSED} select query_id, id, score, rank from fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d)


@query(f"with {FUSED} select query_id, rank, chunk_id, file_path, symbol_name from fused join chunks on chunk_id = id")
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).select("chunk_id", "file_path", "symbol_name")
    return _fused(spark, d).join(rows, F.col("id") == F.col("chunk_id")).select("query_id", "rank", "chunk_id", "file_path", "symbol_name")


def _reranked(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    c = chunks(spark, d)
    text = fusion.preview(F.col("file_path"), F.col("symbol_name"), F.col("signature"), F.col("body"))
    rows = _fused(spark, d).join(c.select(F.col("chunk_id").alias("id"), text.alias("text")), "id").join(asked(spark, d).withColumnRenamed("text", "query"), "query_id")
    return fusion.rerank(rows, k)


@query(f"with {RERANKED} select query_id, id, score, rank from reranked")
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d)


@query(f"""with {RERANKED}, r as (select query_id, file_path, symbol_name, rank from reranked join chunks on chunk_id = id where rank <= 5),
b as (select item_id, min(rank) best from eval_cases join r on query_id = item_id and file_path = expected_file and (expected_symbol is null or expected_symbol = symbol_name) group by 1)
select count(*) cases, round(avg(coalesce(1.0::double / best, 0)), 6) mrr, round(avg((best is not null)::int::double), 6) recall from eval_cases left join b using (item_id)""")
def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    ranked = _reranked(spark, d, 5).join(chunks(spark, d).select(F.col("chunk_id").alias("id"), F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol")), "id")
    want = table(spark, d, "eval_cases").select(F.col("item_id").alias("query_id"), F.col("expected_file").alias("file"), F.col("expected_symbol").alias("symbol"))
    return fusion.evaluate(ranked, want)


@query(f"""with {INDEX}, want as (select parsed_id query_id, max(docstring) text, max(file_path) file, max(symbol_name) symbol from parsed_chunks where parsed_id % 20 = 0 and docstring is not null group by 1),
asked as materialized (select query_id, term, count(*) qtf from (select query_id, unnest({_tokens("text")}) term from want) group by 1, 2),
scored as (select query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score from asked join postings using (term) join lengths using (id) join terms using (term) cross join stats group by query_id, id),
r as (select query_id, id, rank from (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) rank from scored) where rank <= 5 and score > 0),
b as (select w.query_id, min(rank) best from want w join r on r.query_id = w.query_id join chunks on chunk_id = id and file_path = w.file and symbol_name = w.symbol group by 1)
select count(*) cases, round(avg(coalesce(1.0::double / best, 0)), 6) mrr, round(avg((best is not null)::int::double), 6) recall from want left join b using (query_id)""")
def known_item_eval(spark: SparkSession, d: str) -> DataFrame:
    """MRR and recall at 5 of finding a symbol's chunk by its documentation, for every 20th parsed symbol."""
    p = table(spark, d, "parsed_chunks").where("parsed_id % 20 = 0 and docstring is not null")
    want = written(p.groupBy(F.col("parsed_id").alias("query_id")).agg(F.max("docstring").alias("text"), F.max("file_path").alias("file"), F.max("symbol_name").alias("symbol")), "wanted")
    named = chunks(spark, d).select(F.col("file_path").alias("file"), F.col("symbol_name").alias("symbol"), F.col("chunk_id").alias("id"))
    wanted = want.select("query_id", "file", "symbol").join(named, ["file", "symbol"]).select("query_id", "id").join(corpus(spark, d), "id")
    ranked = bm25.places(_index(spark, d), corpus(spark, d), want.select("query_id", "text"), wanted, 5)
    found = ranked.join(want.select("query_id", "file", "symbol"), "query_id")
    return fusion.evaluate(found, want.select("query_id", "file", "symbol"))


@query(f"""with {ANSWERS}, c as (select answer_id, regexp_extract_all(text, '{T.CITATION}', 0) c, regexp_split_to_array(text, '{T.CITATION}') p from answers)
select answer_id, len(c) citations, len(list_filter(p, lambda x: x <> '')) prose, len(text) - len(array_to_string(p, '')) cited_chars from c join answers using (answer_id)""")
def answer_segments(spark: SparkSession, d: str) -> DataFrame:
    """Answers parted into prose and citations."""
    s = answers(spark, d).select("answer_id", "text", T.segments(F.col("text")).alias("s"))
    of = lambda kind: F.filter("s", lambda x: x["kind"] == kind)
    prose = F.aggregate(of("prose"), F.lit(0), lambda n, x: n + F.length(x["text"]))
    return s.select("answer_id", F.size(of("citation")).cast("long").alias("citations"), F.size(of("prose")).cast("long").alias("prose"), (F.length("text") - prose).cast("long").alias("cited_chars"))


@query(f"""with {RERANKED} select query_id, md5(string_agg(printf('[%s:%d-%d]  %s (%s, %s)', file_path, start_line, end_line, coalesce(symbol_name, '<module>'), coalesce(kind, ''), {_language_sql('file_path')}) || chr(10) || body, chr(10) || chr(10) order by rank)) prompt, count(*) parts
from reranked join chunks on chunk_id = id group by query_id""")
def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    rows = _reranked(spark, d).join(prompts.chunk_text(chunks(spark, d)), "id")
    n = rows.groupBy("query_id").agg(F.count("*").alias("parts"))
    return prompts.joined_parts(rows, "query_id").join(n, "query_id").select("query_id", F.md5(F.col("context").cast("binary")).alias("prompt"), "parts")


# --- graph ----------------------------------------------------------------------------------------------------------


@query(f"with {CHUNKS}, {EDGES} select src, dst from cont")
def containment_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.containment(chunks(spark, d)).select("src", "dst")


@query(f"with {CHUNKS}, {EDGES} select src, dst from call")
def call_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.calls(chunks(spark, d)).select("src", "dst")


@query(f"""with {CHUNKS}, {EDGES}, own as (select chunk_id, repo_id, symbol_name from chunks where kind in ('function', 'method', 'constructor')),
defs as (select repo_id, symbol_name, count(*) n from own group by 1, 2)
select src, name, n - (o.chunk_id is not null)::int definitions from sites s join defs d on d.repo_id = s.repo_id and d.symbol_name = name
left join own o on o.chunk_id = src and o.repo_id = s.repo_id and o.symbol_name = name where n - (o.chunk_id is not null)::int > 0""")
def call_links(spark: SparkSession, d: str) -> DataFrame:
    """Calls by name with how many definitions they may mean: one row a call, however common the name."""
    return graph.call_links(chunks(spark, d)).select("src", "name", "definitions")


def _imports(c: DataFrame) -> DataFrame:
    return c.select(F.col("chunk_id").alias("src"), "repo_id", F.explode(parsing.imported_names()).alias("name"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """The edges of the symbol graph, built once for all queries."""
    c = chunks(spark, d)
    return shared(spark, d, "edges", "index_chunks", lambda: graph.build(c, _imports(c)))


@query(f"with {CHUNKS}, {EDGES} select src, dst from imp")
def import_edges(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    return graph.imports(c, _imports(c)).select("src", "dst")


@query(f"with {CHUNKS}, {EDGES} select src, dst, type from edges")
def symbol_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)


SEEDS = "seeds as (select distinct chunk_id seed from chunks)"


@query(f"""with recursive {CHUNKS}, {EDGES}, {SEEDS}, both_ways as (select src, dst from edges union select dst, src from edges),
walk(seed, id, depth) as (select seed, seed, 0::bigint from seeds union select seed, dst, depth + 1 from walk join both_ways on src = id where depth < 2)
select seed, id, min(depth) depth from walk where id <> seed group by 1, 2""")
def khop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d)
    seeds = c.select(F.col("chunk_id").alias("seed"))
    return graph.neighbours(_graph(spark, d), seeds, 2)


@query(f"""with {RERANKED}, {EDGES}, both_ways as (select src, dst from edges union select dst, src from edges),
fresh as (select query_id, dst id, min(rank) seed_rank from reranked join both_ways on src = id where (query_id, dst) not in (select (query_id, id) from reranked) group by 1, 2),
every as (select query_id, id, 0 part, rank seed_rank from reranked union all select query_id, id, 1, seed_rank from fresh)
select query_id, id, rank, part = 0 seed from (select *, row_number() over (partition by query_id order by part, seed_rank, id) rank from every) where rank <= 12""")
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(_graph(spark, d), written(_reranked(spark, d).select("query_id", "id", "rank"), "reranked"))


@query(f"""with {RERANKED}, {EDGES}, both_ways as (select src, dst from edges union select dst, src from edges),
fresh as (select distinct query_id, dst from reranked join both_ways on src = id where (query_id, dst) not in (select (query_id, id) from reranked)),
c as (select e.item_id query_id, (select count(*) from dn where query_id = item_id) n_dense, (select count(*) from bm where query_id = item_id) n_words, (select count(*) from fused where query_id = item_id) n_fused,
(select count(*) from reranked where query_id = item_id) n_reranked, (select count(*) from fresh where query_id = item_id) n_fresh from eval_cases e)
select query_id, n_dense, n_words, n_fused, n_reranked, least(12, n_reranked + n_fresh) n_expanded from c""")
def candidate_funnel(spark: SparkSession, d: str) -> DataFrame:
    dense, words = written(_dense_leg(spark, d), "dense"), written(_bm25_leg(spark, d), "words")
    fused = written(fusion.fuse([dense, words], 20), "fused")
    c = chunks(spark, d)
    text = fusion.preview(F.col("file_path"), F.col("symbol_name"), F.col("signature"), F.col("body"))
    rows = fused.join(c.select(F.col("chunk_id").alias("id"), text.alias("text")), "id").join(asked(spark, d).withColumnRenamed("text", "query"), "query_id")
    best = written(fusion.rerank(rows, 8).select("query_id", "id", "rank"), "reranked")
    grown = graph.expand(_graph(spark, d), best)
    out = asked(spark, d).select("query_id")
    for name, stage in (("n_dense", dense), ("n_words", words), ("n_fused", fused), ("n_reranked", best), ("n_expanded", grown)):
        out = out.join(stage.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    return out.na.fill(0)


# --- citations, grounding, drift ------------------------------------------------------------------------------------

LINES = "lined as materialized (select path file, string_split(regexp_replace(max(content), chr(10) || '$', ''), chr(10)) lines from walked_files where content is not null and path in (select file from cited) group by 1)"
CHECKED = f"""{CITED}, {LINES}, joined as (select c.*, a.text, l.lines, "start" >= 1 and "start" <= "end" and "end" <= len(l.lines) ok from cited c join answers a using (answer_id) left join lined l using (file)),
w as (select *, list_distinct(list_transform(regexp_extract_all(text, '{T.IDENTIFIER}'), lambda x: lower(x))) a,
  list_distinct(list_transform(regexp_extract_all(array_to_string(list_slice(lines, "start", "end"), chr(10)), '{T.IDENTIFIER}'), lambda x: lower(x))) b from joined),
checked as (select answer_id, pos, file, "start", "end", lines is not null and ok as exists,
  case when lines is not null and ok and len(a) > 0 and len(b) > 0 then round(len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))), 6) else 0.0 end similarity,
  case when lines is null then 'file not found' when not ok then 'line range out of bounds' else '' end reason from w)"""


def _disk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "walked_files").where("content is not null").groupBy(F.col("path").alias("file")).agg(F.max("content").alias("content"))


@query(f'with {CHECKED} select answer_id, pos, file, "start", "end", "exists", similarity, reason from checked')
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    return grounding.validate(answers(spark, d), _disk(spark, d))


@query(f"""with {CHECKED}, g as (select answer_id, count(*) citations, bool_and("exists") ok from checked group by 1)
select answer_id, coalesce(ok, false) ok, coalesce(citations, 0) citations from answers left join g using (answer_id)""")
def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    return grounding.answer_ok(grounding.validate(a, _disk(spark, d)), a)


GROUNDED = f"""{CITED}, {CHUNKS},
prem as (select distinct c.answer_id, k.chunk_id, k.body premise from cited c join chunks k on k.file_path = c.file and c."start" between k.start_line and k.end_line),
sent as (select answer_id, unnest(range(len(s))) pos, unnest(s) sentence from (select answer_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), lambda x: {_strip('x')}), lambda x: x <> '') s from answers)),
pw as materialized (select answer_id, list_distinct(list_transform(regexp_extract_all(premise, '[A-Za-z_]+'), lambda x: lower(x))) p from prem),
sw as (select answer_id, pos, list_distinct(list_transform(regexp_extract_all(sentence, '[A-Za-z_]+'), lambda x: lower(x))) h from sent),
best as (select answer_id, pos, max(coalesce(case when len(h) = 0 then 0.0 else round(len(list_intersect(p, h))::double / len(h), 4) end, 0.0)) best from sw left join pw using (answer_id) group by 1, 2),
grounded as (select a.answer_id, coalesce(round(avg(best), 4), 0.0) score from answers a left join best using (answer_id) group by 1)"""


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    a, c = answers(spark, d), chunks(spark, d)
    premises = grounding.cited_chunks(grounding.cited(a), c).join(c.select("chunk_id", F.col("body").alias("premise")), "chunk_id")
    return grounding.ground(a, premises)


@query(f"with {GROUNDED} select answer_id, score, case when score >= 0.75 then 'high' when score >= 0.5 then 'medium' when score >= 0.25 then 'low' else 'none' end verdict from grounded")
def grounding_score(spark: SparkSession, d: str) -> DataFrame:
    return _grounded(spark, d)


CLAIMED = f"""{INDEX},
asked as materialized (select item_id query_id, term, count(*) qtf from (select item_id, unnest({_tokens("coalesce(reference_answer, '')")}) term from eval_cases) group by 1, 2),
scored as (select query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
  from asked join postings using (term) join lengths using (id) join terms using (term) cross join stats group by query_id, id),
near as (select * from (select query_id, id, row_number() over (partition by query_id order by score desc, id) rank, score from scored) where rank <= 8 and score > 0),
pair as (select n.query_id, n.id, n.rank, list_distinct(list_transform(regexp_extract_all(c.text, '[A-Za-z_]+'), lambda x: lower(x))) p, list_distinct(list_transform(regexp_extract_all(e.reference_answer, '[A-Za-z_]+'), lambda x: lower(x))) h
  from near n join corpus c on c.id = n.id join eval_cases e on e.item_id = n.query_id),
ent as (select query_id, id, rank, case when len(h) = 0 then 0.0 else round(len(list_intersect(p, h))::double / len(h), 4) end entail from pair),
con as (select *, round((1 - entail) / 2, 4) contra from ent),
bst as (select query_id, max(entail) e, first(id order by entail desc, rank) eid, max(contra) c, first(id order by contra desc, rank) cid from con group by 1),
finding as (select item_id claim_id, case when e >= 0.5 then 'supported' when c >= 0.5 then 'contradicted' else 'not_found' end status,
  round(case when e >= 0.5 then e when c >= 0.5 then c else coalesce(e, 0.0) end, 4) score, case when e < 0.5 and c >= 0.5 then cid else eid end chunk_id from eval_cases left join bst on query_id = item_id)"""


def _findings(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "eval_cases").select(F.col("item_id").alias("claim_id"), F.coalesce("reference_answer", F.lit("")).alias("claim"))
    near = bm25.top_k(bm25.scores(_index(spark, d), claims.select(F.col("claim_id").alias("query_id"), F.col("claim").alias("text"))), 8)
    retrieved = near.join(corpus(spark, d), "id").select(F.col("query_id").alias("claim_id"), F.col("id").alias("chunk_id"), "rank", "text")
    return drift.check(claims, retrieved)


@query(f"with {CLAIMED} select claim_id, status, score, chunk_id from finding")
def drift_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d)


@query(f"""with {CLAIMED}, o(ord, status) as (values (0::bigint, 'contradicted'), (1, 'not_found'), (2, 'supported'))
select ord, status, count(claim_id) n from o left join finding using (status) group by 1, 2""")
def drift_report_counts(spark: SparkSession, d: str) -> DataFrame:
    return drift.counts(_findings(spark, d))


@query(f"""with {CLAIMED}, n as (select count(*) filter (status = 'contradicted') a, count(*) filter (status = 'not_found') b, count(*) filter (status = 'supported') c from finding)
select '{{"counts":{{"contradicted":' || a || ',"not_found":' || b || ',"supported":' || c || '}},"has_contradictions":' || case when a > 0 then 'true' else 'false' end || '}}' report from n""")
def drift_report_json(spark: SparkSession, d: str) -> DataFrame:
    return drift.report_json(_findings(spark, d))


RAW = """raw as (select doc_id, 'Here: [{"claim": " ' || regexp_replace(coalesce(source, ''), '[^A-Za-z_]', '', 'g') || ' ", "line": ' || n_chars || '}, {"line": 3}, {"claim": "x", "line": "two"}] end' raw, 1 + length(text) - length(replace(text, chr(10), '')) n from documents where text is not null)"""


@query(f"""with {RAW} select doc_id::varchar doc_file, 0::bigint pos, trim(json_extract_string(regexp_extract(raw, '(?s)\\[.*\\]', 0), '$[0].claim')) claim, greatest(1, least(json_extract(regexp_extract(raw, '(?s)\\[.*\\]', 0), '$[0].line')::bigint, greatest(n, 1))) doc_line from raw where trim(json_extract_string(regexp_extract(raw, '(?s)\\[.*\\]', 0), '$[0].claim')) <> ''
union all select doc_id::varchar, 2, 'x', 1 from raw""")
def claims_from_json(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    word = F.regexp_replace(F.coalesce("source", F.lit("")), "[^A-Za-z_]", "")
    raw = F.concat(F.lit('Here: [{"claim": " '), word, F.lit(' ", "line": '), F.col("n_chars").cast("string"), F.lit('}, {"line": 3}, {"claim": "x", "line": "two"}] end'))
    n = 1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return drift.parse_claims(docs.select(F.col("doc_id").cast("string").alias("doc_file"), raw.alias("raw"), n.alias("n_lines")))


# --- store ----------------------------------------------------------------------------------------------------------


@query("""with f as (select repo_id, path, max(content) as content from walked_files where content is not null group by 1, 2), c as (select repo_id, file_path path, count(distinct chunk_id) n from index_chunks group by 1, 2)
select f.repo_id, f.path, sha256(content) content_hash, coalesce(n, 0) num_chunks from f left join c on c.repo_id = f.repo_id and c.path = f.path""")
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "walked_files").where("content is not null").groupBy("repo_id", "path").agg(F.max("content").alias("content"))
    return store.file_stats(f, table(spark, d, "index_chunks"))


@query(f"""with f as (select repo_id, path, max(num_chunks) n, {_language_sql('path')} l from files group by 1, 2)
select repo_id, count(*) num_files, sum(n)::bigint num_chunks, array_to_string(list_sort(list_distinct(list(l))), ',') languages from f group by 1""")
def repo_stats(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").groupBy("repo_id", "path").agg(F.max("num_chunks").alias("num_chunks"))
    return store.repo_stats(f.withColumn("language", T.language_of(F.col("path"))))


@query("""with o as (select repo_id, path, max(content_hash) h from files group by 1, 2), n as (select repo_id, path, max(sha256(content)) h from walked_files where content is not null group by 1, 2)
select repo_id, path, h content_hash from n union all select repo_id, path, h from o where (repo_id, path) not in (select (repo_id, path) from n)""")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "files").groupBy("repo_id", "path").agg(F.max("content_hash").alias("content_hash"))
    new = table(spark, d, "walked_files").where("content is not null").groupBy("repo_id", "path").agg(F.max(F.sha2("content", 256)).alias("content_hash"))
    return store.upsert(old, new, ["repo_id", "path"])


@query("""select f.repo_id, count(distinct path) files from files f where f.repo_id not in (select id from repos where status = 'error') group by 1""")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repos")
    _, kept = store.delete_cascade(repos, table(spark, d, "files"), repos.where("status = 'error'"))
    return kept.groupBy("repo_id").agg(F.count_distinct("path").alias("files"))


@query(f"""with k as (select distinct chunk_id, sha256('stub' || chr(10) || body) key, indexed_at from index_chunks where body is not null),
cache as (select distinct key from k where indexed_at < timestamptz '{CACHED_UNTIL}') select count(*) filter (key in (select key from cache)) hits, count(*) filter (key not in (select key from cache)) misses from (select distinct chunk_id, key from k)""")
def cache_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "index_chunks").where("body is not null").select("chunk_id", store.cache_key("stub", "body").alias("key"), "indexed_at").distinct()
    rows = written(rows, "keys")
    hit, miss = store.probe(rows.select("chunk_id", "key").distinct(), rows.where(F.col("indexed_at") < F.lit(CACHED_UNTIL).cast("timestamp")))
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))


@query("""with f as (select repo_id, count(distinct path) files from files group by 1)
select row_number() over (order by created_at desc, id) pos, id, status, len(json_extract(languages, '$[*]')) n_languages, coalesce(files, 0) files from repos left join f on repo_id = id""")
def repo_listing(spark: SparkSession, d: str) -> DataFrame:
    """All repositories, the newest first, with their recorded files."""
    from pyspark.sql import Window

    r = table(spark, d, "repos")
    f = table(spark, d, "files").groupBy(F.col("repo_id").alias("id")).agg(F.count_distinct("path").alias("files"))
    pos = F.row_number().over(Window.orderBy(F.desc("created_at"), "id")).cast("long")  # repos is a table of few rows
    listed = r.select(pos.alias("pos"), "id", "status", F.size(F.from_json("languages", "array<string>")).cast("long").alias("n_languages"))
    return listed.join(f, "id", "left").na.fill(0, ["files"])


@query("""with k as (select path, max(repo_id) repo_id, count(*) n from files group by 1) select r.id, r.status, count(k.path) files from repos r left join k on k.repo_id = r.id where r.status in ('ready', 'pending', 'indexing') group by 1, 2""")
def ready_repos(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "files").groupBy("path").agg(F.max("repo_id").alias("id"))
    r = table(spark, d, "repos").where(F.col("status").isin("ready", "pending", "indexing"))
    return r.join(k, "id", "left").groupBy("id", "status").agg(F.count("path").alias("files"))


# --- events ---------------------------------------------------------------------------------------------------------

STATE = "select user_id, arg_max(event_type, (ts, event_id)) event_type, max(ts) ts, count(*) events from events group by 1"


@query(STATE)
def progress_state(spark: SparkSession, d: str) -> DataFrame:
    return progress.current_state(table(spark, d, "events"))


@query(STATE)
def progress_stream(spark: SparkSession, d: str) -> DataFrame:
    return progress.stream_state(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


@query(f"""with {GROUNDED}, spans_of as (select answer_id, count(*) n from cited group by 1), tok as (select answer_id, len(regexp_extract_all(text, '\\S+\\s*')) n from answers)
select a.answer_id, t.n tokens, coalesce(s.n, 0) citations, t.n + coalesce(s.n, 0) + 2 as events from answers a join tok t using (answer_id) left join spans_of s using (answer_id)""")
def ask_event_stream(spark: SparkSession, d: str) -> DataFrame:
    a = answers(spark, d)
    spans = F.transform(T.citations(F.col("text")), lambda c: F.concat(c["file"], F.lit(":"), c["start"].cast("string"), F.lit("-"), c["end"].cast("string")))
    rows = progress.answer_events(a.join(_grounded(spark, d), "answer_id").withColumn("citations", spans))
    return rows.groupBy("answer_id").agg(F.count_if(F.col("event") == "token").alias("tokens"), F.count_if(F.col("event") == "citation").alias("citations"), F.count("*").alias("events"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
