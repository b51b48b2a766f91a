"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import find_matches
from .html_wrappers import extract
from .jaccard_join import linked
from .line_dedup import dedup_lines
from .mixing import mix
from .pii import pseudonymise
from .quality_rules import BOILERPLATE, ENDS, NAVIGATION, SENTENCE, measure
from .substring_dedup import remove_repeats
from .token_files import through_files
from .warc import through_archives


#: known to everybody, for tests and comparisons: name a secret one in spark.terragrid.pii.key
PUBLIC_KEY = "public"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, spark.conf.get("spark.terragrid.pii.key", PUBLIC_KEY)).select("doc_id", "n_found", "safe_text")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs, "doc_id", "text", 3, 90)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_archives(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, "text", 35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "n_lost_words")


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_matches(docs, _table(spark, sf_dir, "benchmark"), "text", 10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_files(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_wrappers": op6_html_wrappers,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(pattern: str) -> str:
    """A pattern as SQL text for an engine without lookaround."""
    word = r"[\p{L}\p{N}]"
    return "'" + re.sub(r"^\(\?=\[[^]]*\]\)", "", pattern).replace("(?<!" + word + ")", r"(?:^|[^\p{L}\p{N}])").replace("(?!" + word + ")", r"(?:$|[^\p{L}\p{N}])").replace("'", "''") + "'"


def _many(chars: str) -> str:
    return f"(length(x) - length(translate(x, '{chars}', '')))"


ORACLE_SQL = {
    "op2_jaccard_join": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') ws from documents),
s as materialized (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) g from w),
n as materialized (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id u, b.doc_id v, count(*) c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
l as materialized (select u, v from c join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id u, doc_id v from w union select r.u, l.v from r join l on l.u = r.v),
k as (select u, min(v) component_id from r group by u),
d as (select u, count(*) n_links from l group by u)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, k.component_id, cast(coalesce(d.n_links, 0) as bigint) n_links
from w left join n using (doc_id) left join k on k.u = w.doc_id left join d on d.u = w.doc_id""",
    "op5_quality_rules": rf"""
with w as (select doc_id, coalesce(text, '') t, {_WORDS} ws from documents),
e as (select doc_id, len(ws) n, unnest(range(1, len(ws) + 1)) i, unnest(list_transform(range(1, len(ws) + 1), lambda i: array_to_string(ws[i:i + 7], ' '))) g from w),
r as (select doc_id, i, count(*) over (partition by doc_id, g) c from e where i + 7 <= n),
k as (select e.doc_id, e.i, max(coalesce(case when r.c > 1 then r.i end, -99)) over (partition by e.doc_id order by e.i) s from e left join r on r.doc_id = e.doc_id and r.i = e.i),
p as (select doc_id, sum((i - s < 8)::int) n from k group by doc_id),
b as (select doc_id, unnest(string_split(t, chr(10))) x from w),
f as (select doc_id, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) n from b),
j as (select doc_id, x, n, {_many("#*$%&|<>")} * 5 > length(translate(x, {_BLANKS}, '')) or {_many("|>»•")} * 3 >= n
  or (n >= 3 and {_many("!?")} * 3 > n * 2 and len(regexp_extract_all(x, '[!?]{{2,}}')) * 3 > n)
  or (n >= {SENTENCE} and not regexp_matches(x, {_quoted(ENDS)}))
  or (n < 8 and regexp_matches(lower(x), {_quoted(NAVIGATION)})) or regexp_matches(lower(x), {_quoted(BOILERPLATE)}) bad from f where n > 0),
l as (select doc_id, count(*) - count(distinct x) dup, count(*) filter (bad) bad, coalesce(sum(n) filter (bad), 0) lost from j group by doc_id),
q as (select w.doc_id, cast(len(ws) as bigint) n_words, cast(length(array_to_string(ws, '')) as bigint) word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols, cast(coalesce(dup, 0) as bigint) n_dup_lines, cast(coalesce(p.n, 0) as bigint) n_repeat_words,
  cast(coalesce(bad, 0) as bigint) n_bad_lines, cast(coalesce(lost, 0) as bigint) n_lost_words from w left join p using (doc_id) left join l using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 2 * n_lost_words <= n_words kept from q""",
    "op7_decontaminate": rf"""
with w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select coalesce(cast(item_id as varchar), '') item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
i as materialized (select distinct item, least(10, len(ws)) k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda j: array_to_string(ws[j:j + least(10, len(ws)) - 1], ' '))) g from b where len(ws) > 0),
k as (select distinct k from i),
d as (select doc_id, k, unnest(range(1, len(ws) - k + 2)) j, unnest(list_transform(range(1, len(ws) - k + 2), lambda j: array_to_string(ws[j:j + k - 1], ' '))) g from w cross join k where len(ws) >= k),
m as materialized (select doc_id, j, d.k, item from d join i on i.g = d.g and i.k = d.k),
h as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(j, j + k)) p from m) group by doc_id),
t as (select doc_id, count(*) n, string_agg(item, ',' order by item) s from (select distinct doc_id, item from m) group by doc_id),
x as materialized (select item, k, p + 1 i, ws from (select item, least(10, len(ws)) k, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) p, ws from b where len(ws) > 0)),
y as (select m.doc_id, d.ws dw, x.ws iw, m.j, x.i, m.k from (select distinct doc_id, j, k, item from m) m join w d using (doc_id) join x on x.item = m.item and x.k = m.k and array_to_string(x.ws[x.i:x.i + m.k - 1], ' ') = array_to_string(d.ws[m.j:m.j + m.k - 1], ' ')),
o as (select doc_id, max(coalesce(list_position(list_transform(range(0, least(len(dw) - j, len(iw) - i) + 1), lambda z: dw[j + z] = iw[i + z]), false) - 1, least(len(dw) - j, len(iw) - i) + 1)) longest from y group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(h.n, 0) as bigint) n_hit, cast(coalesce(t.n, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated, cast(coalesce(longest, 0) as bigint) longest
from w left join h using (doc_id) left join t using (doc_id) left join o using (doc_id)""",
    "op3_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, octet_length(encode(h)) b, sha1(h) d, max(page_id) over (partition by sha1(h)) m from p)
select page_id, cast(b as bigint) payload_bytes, d payload_digest,
  case when b >= 1000 and m <> page_id then 'revisit' else 'response' end record_type,
  case when b >= 1000 and m <> page_id then m end refers_to
from q""",
    "op4_substring_dedup": f"""
with w as (select doc_id, {_WORDS} ws from documents),
e as (select doc_id, unnest(range(1, len(ws) + 1)) i, unnest(ws) x, len(ws) n from w),
v as (select doc_id, i, md5(string_agg(x, ' ' order by i) over (partition by doc_id order by i rows between current row and 34 following)) h, n from e),
r as (select doc_id, i, count(*) over (partition by h) c from v where i + 34 <= n),
k as (select e.doc_id, e.i, e.x, max(coalesce(case when r.c > 1 then r.i end, -99)) over (partition by e.doc_id order by e.i) s from e left join r on r.doc_id = e.doc_id and r.i = e.i),
g as (select doc_id, sum((i - s < 35)::int) gone, string_agg(case when i - s >= 35 then x end, ' ' order by i) kept from k group by doc_id)
select w.doc_id, cast(len(ws) as bigint) n_words, cast(coalesce(gone, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
from w left join g using (doc_id)""",
}
