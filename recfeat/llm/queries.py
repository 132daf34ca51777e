"""The corpus operators as queries over the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, licenses, mixing, neardup, pii, prefixtrie, quality, sharding, tokenfiles, toxicity, urlfilter, whitening

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key for the queries; a production run passes its own secret.
PSEUDONYM_KEY = "recfeat-query-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), tokenizer)


def op5_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_table(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = langid.held_out()
    model = langid.fit(docs.filter(~held).select("doc_id", "text", "lang"))
    return langid.identify(docs, *model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "mix")


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), alpha=0.7)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = toxicity.held_out()
    model = toxicity.fit(docs.filter(~held), _table(spark, sf_dir, "labels").filter(~held))
    return toxicity.score(docs, *model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, sf_dir, "embeddings"), most=32)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(_table(spark, sf_dir, "conversations"), family=5, modulus=9)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


_OP8_SQL = rf"""
with recursive w as materialized (
    select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
    from documents),
s as materialized (
    select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                      when len(w) = 1 then [w[1]] else [] end) s from w),
e as materialized (select doc_id, len(s) n, unnest(s) x from s),
links as materialized (
    select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as materialized (select a, b from links union all select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least_of as (select a, min(b) m from reach group by a)
select s.doc_id, len(s.s)::bigint n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) component_id, s.doc_id <= coalesce(m, s.doc_id) kept
from s left join least_of on s.doc_id = a
"""

_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP2_SQL = f"""
with d as materialized (select doc_id, {_WORDS} w from documents),
b as materialized (select item_id, {_WORDS} w from benchmark where item_id is not null),
bw as materialized (
    select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') g
    from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
dw as materialized (
    select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') g
    from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from bw) where len(w) >= k)),
hit as materialized (select doc_id, i, k, g from dw where (k, g) in (select (k, g) from bw)),
words as (select doc_id, count(*) n from (select distinct doc_id, unnest(range(i, i + k)) p from hit) group by doc_id),
items as (
    select doc_id, count(*) n, sha256(string_agg(item, ',' order by item)) h
    from (select distinct doc_id, item_id::varchar item from hit join bw using (k, g)) group by doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(words.n, 0) n_hit, coalesce(items.n, 0) n_items,
    coalesce(h, sha256('')) items_sha256, coalesce(words.n, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::varchar[]"


_OP3_SQL = f"""
with d as materialized (select row_number() over () r, doc_id, {_WORDS} w from documents),
p(words, label) as (values {", ".join(f"(string_split('{p}', ' '), '{v}')" for p, v in licenses.PHRASES.items())}),
places as (select r, label, i from (select r, w, unnest(range(1, len(w) + 1)) i from d), p where w[i:i + len(words) - 1] = words),
base as (select r, count(*) n, min(i) - 1 lo, max(i) - 1 hi, list(distinct label) labels from places group by r),
t(id, label, step, reach, words, needs, bars) as (values
    {", ".join(f"({i}, '{t.label}', {licenses.step_of(t)}, {len(t.text.split())}, list_distinct(string_split('{t.text}', ' ')), {_sql_list(t.needs)}, {_sql_list(t.bars)})" for i, t in enumerate(licenses.TEMPLATES))}),
steps as (select distinct step from t),
b as (
    select r, step, w[s:s + 2 * step - 1] o, list_distinct(w[s:s + 2 * step - 1]) x
    from (select r, w, step, unnest(range(1, greatest(1, len(w) - step) + 1, step)) s from d, steps)),
m as (
    select r, len(list_intersect(x, words)) / len(words) share, case when len(needs) = 0 or len(list_filter(range(1, len(o) + 1),
        lambda p: o[p] = needs[1] and list_has_all(o[greatest(1, p - reach):p + reach], needs) and not list_has_any(o[greatest(1, p - reach):p + reach], bars))) > 0 then label end label
    from b join t using (step) where len(list_intersect(x, words)) >= {licenses.THRESHOLD}::double * len(words) - 1e-9::double),
found as (select r, count(*) n, max(share) best, coalesce(list(distinct label) filter (where label is not null), []) labels from m group by r)
select doc_id, len(w)::bigint n_words, coalesce(base.n, 0) n_base, lo first_word, hi last_word,
    array_to_string(list_sort(coalesce(base.labels, [])), ',') base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') labels,
    case when base.n > 0 then 1.0::double else coalesce(best, 0.0::double) end score, coalesce(found.n, 0) n_blocks
from d left join base using (r) left join found using (r)
"""

_GRAMS = (3, *quality.LATER_LIMITS)
_OP5_SQL = rf"""
with d as materialized (
    select row_number() over () r, doc_id, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
g as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') k from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from d, (values {", ".join(f"({n})" for n in _GRAMS)}) v(n) where len(w) >= n)),
c as (select r, n, i, count(*) over (partition by r, n, k) c, row_number() over (partition by r, n, k order by i) nth from g),
p as (select distinct r, n, unnest(range(i, i + n)) j from c where c > 1),
q as (select distinct r, n, unnest(range(i, i + n)) j from c where nth > 1),
later as (select q.r, n, sum(length(w[j])) chars from q join d using (r) group by q.r, n),
laterpiv as (select r, {", ".join(f"coalesce(max(chars) filter (where n = {n}), 0) l{n}" for n in quality.LATER_LIMITS)} from later group by r),
cov as (select p.r, n, count(*) words, sum(length(w[j])) chars from p join d using (r) group by p.r, n),
piv as (select r, coalesce(max(words) filter (where n = 3), 0) rep, {", ".join(f"coalesce(max(chars) filter (where n = {n}), 0) c{n}" for n in quality.LATER_LIMITS)} from cov group by r),
l as (select r, line, row_number() over (partition by r, line) k from (select r, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
lines as (select r, count(*) filter (where k > 1) dup, coalesce(sum(length(line)) filter (where k > 1), 0) dup_chars, sum(length(line)) chars from l group by r),
f as (
    select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        coalesce(dup, 0) n_dup_lines, coalesce(rep, 0) n_repeat_words, {", ".join(f"coalesce(c{n}, 0)::double / greatest(1, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) dup_{n}" for n in quality.LATER_LIMITS)},
        coalesce(dup_chars::double / greatest(1, chars), 0.0::double) dup_line_chars,
        {", ".join(f"coalesce(l{n}, 0)::double / greatest(1, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)) later_{n}" for n in quality.LATER_LIMITS)}
    from d left join piv using (r) left join laterpiv using (r) left join lines using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or dup_line_chars > {quality.LINE_CHAR_LIMIT}::double or {" or ".join(f"later_{n} > {v}::double" for n, v in quality.LATER_LIMITS.items())}) kept
from f
"""

# The checksum, bit by bit: each byte goes in before the first of its eight steps.
_CRC32 = """
    xor(4294967295, list_reduce(
        list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)))
"""

_OP12_SQL = f"""
with raw as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations where conv_id is not null),
named as (select conv_id, turn, md5(strlen(r) || ':' || r || x) id, strlen(x) size from raw),
t as materialized (select conv_id, id, size, row_number() over (partition by conv_id order by turn nulls first, id) i from named),
c as materialized (select conv_id, count(*) n, {_CRC32} % 9 h from t group by conv_id),
part as (
    select c.conv_id, t.i pos, t.id, t.size from c join t on t.conv_id = c.conv_id - c.conv_id % 5 where t.i <= c.h
    union all
    select c.conv_id, least(c.h, coalesce(b.n, 0)) + t.i - c.h, t.id, t.size
    from c join t on t.conv_id = c.conv_id left join c b on b.conv_id = c.conv_id - c.conv_id % 5 where t.i > c.h),
made as (select conv_id, list(id order by pos) ids, list(size order by pos) sizes from part group by conv_id),
seqs as (select conv_id, coalesce(ids, []) ids, coalesce(sizes, []) sizes from c left join made using (conv_id)),
mem as (select conv_id, ids, sizes, unnest(range(0, len(ids) + 1)) d from seqs),
node as materialized (
    select d, ids[1:d] p, count(*) n, min(conv_id) least_id, any_value(sizes[d]) size,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(ids) = d), '')) ends
    from mem group by d, ids[1:d]),
kids as (select d - 1 d, p[1:d - 1] p, count(*) k from node where d > 0 group by all),
own as (select node.d, node.p, (n - 1) * coalesce(size, 0) saved, (k is null)::bigint leaf from node left join kids on node.d = kids.d and node.p = kids.p),
up as (select saved, leaf, p, unnest(range(0, d + 1)) e from own),
sub as (select e d, p[1:e] p, sum(saved) saved, sum(leaf) leaves from up group by all)
select node.least_id conv_id, node.d depth, above.least_id parent_conv_id, node.n n_convs, coalesce(k, 0) n_children,
    leaves::bigint n_leaves, saved::bigint saved_tokens, node.ends ends_sha256
from node join sub on node.d = sub.d and node.p = sub.p left join kids on node.d = kids.d and node.p = kids.p
left join node above on node.d > 0 and above.d = node.d - 1 and above.p = node.p[1:node.d - 1]
"""


def _sql_url(url: str) -> str:
    """SQL columns host, path and query of the expression ``url``."""
    rest = f"case when position('://' in {url}) > 0 then substr({url}, position('://' in {url}) + 3) else '' end"
    return (
        f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) path, "
        rf"regexp_extract({rest}, '^[^?#]*(\?[^#]*)', 1) query"
    )


_quoted = lambda pattern: pattern.replace("'", "''")
_OP13_SQL = rf"""
with recursive page as materialized (select page_id, {_sql_url("coalesce(url, '')")}, html from pages),
mine as materialized (select *, case when host <> '' then host || rtrim(path, '/') || query end a from page),
tag as (select a, host, path, unnest(regexp_extract_all(regexp_replace(html, '{urlfilter.COMMENT}', '', 'g'), '{urlfilter.TAGS}')) t from mine where a is not null),
target as (
    select a, host, path, replace(case when regexp_matches(t, '{_quoted(urlfilter.CANONICAL)}') then regexp_extract(t, '{_quoted(urlfilter.LINK_TARGET)}', 1)
        when regexp_matches(t, '{_quoted(urlfilter.REFRESH)}') then regexp_extract(t, '{_quoted(urlfilter.REFRESH_TARGET)}', 1) else '' end, '&amp;', '&') t from tag),
url as (
    select a, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then 'x:' || t
        when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') or starts_with(t, '#') then null
        when starts_with(t, '/') then 'x://' || host || t when starts_with(t, '?') then 'x://' || host || path || t
        else 'x://' || host || case when path = '' then '/' else regexp_extract(path, '(?s)^(.*/)?') end || t end u
    from target where t <> ''),
link as (select a, {_sql_url("u")} from url where u is not null),
edge as materialized (select a, host, path, host || rtrim(path, '/') || query b from link where host <> ''),
seen as (select host, path, a from mine where a is not null union select host, path, b from edge),
rules(verdict, rh, rp) as (values {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in urlfilter.RULES)}),
fits as (
    select seen.*, rh || rp rule, verdict rv, row_number() over (partition by host, path, a order by length(rh || rp) desc nulls last, length(rh) desc, verdict, rh || rp desc) k
    from seen left join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)),
said as materialized (select * from fits where k = 1),
both_ways as materialized (select a, b from edge union select b, a from edge),
reach(a, b) as (select a, a from said union select r.a, e.b from reach r join both_ways e on r.b = e.a),
alias as (
    select r.a, max(rule) filter (where rv = 'block') via, coalesce(bool_or(rv = 'allow'), false) ok
    from reach r join said on said.a = r.b group by r.a)
select page_id, mine.host, mine.path, rule, coalesce(rv, case when via is not null and not ok then 'block' else 'allow' end) verdict,
    case when rule is null and not ok then via end via
from mine left join said on said.host = mine.host and said.path = mine.path and said.a = mine.a left join alias on alias.a = mine.a
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_pseudonyms, op2_decontamination, op3_license_scan, op4_token_files, op5_repetition_quality,
        op6_language_mixture, op7_hilbert_shards, op8_near_duplicates, op9_mixed_sources, op10_toxicity,
        op11_embedding_whitening, op12_prefix_trie, op13_url_filter,
    )
}
ORACLE: dict[str, str] = {
    "op2_decontamination": _OP2_SQL,
    "op3_license_scan": _OP3_SQL,
    "op5_repetition_quality": _OP5_SQL,
    "op8_near_duplicates": _OP8_SQL,
    "op12_prefix_trie": _OP12_SQL,
    "op13_url_filter": _OP13_SQL,
}
