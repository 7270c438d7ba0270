"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversation_trie import conversation_trie
from .decontam import contamination
from .frames import documents
from .langid import language_id
from .license_scan import license_scan, scan_sql
from .media import as_media, audio_features, media_columns
from .mixing import mixing
from .ngram_join import ngram_join
from .packing import best_fit_packing
from .quality import quality_scores
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_alignment import token_alignment
from .token_counts import token_counts


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir), digest=True)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(as_media(documents(spark, sf_dir)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digest=True)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(documents(spark, sf_dir))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(documents(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_ngram_join, op2_suffix_dedup, op3_license_scan, op4_best_fit_packing, op5_quality, op6_language_id, op7_media, op7_audio_features, op8_decontamination, op9_token_counts, op10_substring_dedup, op11_mixing, op12_token_alignment, op13_conversation_trie]
    return {f.__name__: f for f in ops}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK, _ALNUM = "'[^\\x20\\x09-\\x0D]+'", "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"

_OP1 = f"""with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_BLANK}), []) as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.b from r join e on e.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, k.component_id from d left join n on n.doc_id = d.doc_id join (select a, min(b) as component_id from r group by a) k on k.a = d.doc_id"""

_OP8 = f"""with d as (select doc_id, coalesce(regexp_extract_all({_LOWER}, {_ALNUM}), []) as w from documents),
i as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark where text is not null),
v as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 11, 2))) as k from i where len(w) > 0)),
p as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from v))),
h as (select p.doc_id, p.n, p.k, v.item_id from p join v on v.n = p.n and v.g = p.g),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(k, k + n)) as pos from h) group by doc_id),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join c on c.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""

_OP10 = f"""with d as (select doc_id, coalesce(regexp_extract_all(text, {_BLANK}), []) as w from documents),
p as (select doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as k from d)),
f as (select g, min(doc_id) as least from p group by g having count(*) > 1),
x as (select distinct doc_id, unnest(range(k, k + 50)) as pos from (select p.doc_id, p.k from p join f on f.g = p.g where f.least < p.doc_id)),
o as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d),
y as (select o.doc_id, count(*) as n, string_agg(word, ' ' order by o.pos) as kept from o anti join x on x.doc_id = o.doc_id and x.pos = o.pos group by o.doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(y.n, 0) as n_removed, sha256(coalesce(y.kept, '')) as kept_sha256 from d left join y on y.doc_id = d.doc_id"""

_OP11 = f"""with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, {_BLANK})), 0) as size, md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key from documents),
s as (select source, sum(size) as n, 2.0::double * sum(size)::double as cap, ([3.0, 1.0, 2.0]::double[])[(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from d group by source),
l as (select *, cap + coalesce(sum(cap) over a, 0) + cap / w * (sum(w) over () - w - coalesce(sum(w) over a, 0)) <= 1.5 * sum(n) over () as is_full, 1.5::double * sum(n) over () as whole from s window a as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
t as (select source, n, case when is_full then cap else least(cap, (whole - sum(case when is_full then cap else 0 end) over ()) * w / sum(case when is_full then 0 else w end) over ()) end as target from l),
p as (select d.doc_id, d.size, t.n, t.target, floor(t.target + 0.5)::bigint as budget, coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as earlier from d join t on d.source is not distinct from t.source),
e as (select *, case when n > 0 then budget // n else 0 end::bigint as epochs from p)
select doc_id, size, n::bigint as source_size, target, (epochs * size + least(size, greatest(0, budget - epochs * n - earlier)))::bigint as taken, epochs from e"""

_OP13 = """with recursive bits as (select i::bigint as i, 0 as k, i::bigint as c from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bits where k < 8),
ids as (select distinct conv_id from conversations where conv_id is not null),
crc as (select conv_id, conv_id::varchar as s, 0 as k, 4294967295::bigint as c from ids union all select conv_id, s, crc.k + 1, xor(bits.c, crc.c >> 8) from crc join bits on bits.k = 8 and bits.i = xor(crc.c, ascii(s[crc.k + 1])) & 255 where crc.k < length(s)),
heads as (select conv_id, xor(c, 4294967295) % 6 as h from crc where k = length(s)),
o as (select conv_id, g, n, row_number() over (partition by conv_id order by turn nulls first, g) as k from (select conv_id, turn, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as g, length(coalesce(text, '')) as n from conversations where conv_id is not null)),
r as (select c.conv_id, k, g, n from heads c join o on o.conv_id = c.conv_id - c.conv_id % 100 and k <= h union all select c.conv_id, k, g, n from heads c join o on o.conv_id = c.conv_id and k > h),
m as (select conv_id, row_number() over w as depth, n, md5(string_agg(g, '') over w) as node from r window w as (partition by conv_id order by k) union all select conv_id, 0, 0, '' from ids),
nodes as (select node, any_value(depth) as depth, any_value(n) as size, min(conv_id) as conv_id, count(*) as n_convs from m group by node),
up as (select x.node, x.depth, x.n_convs, x.size, m.node as above, m.depth as above_depth from nodes x join m on m.conv_id = x.conv_id and m.depth <= x.depth),
kids as (select above, count(*) as n_children from up where above_depth = depth - 1 group by above),
below as (select up.above, sum((n_convs - 1) * size) as saved, sum((n_children is null)::int) as leaves from up left join kids on kids.above = up.node group by up.above),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from (select conv_id, arg_max(node, depth) as node from m group by conv_id) group by node)
select x.conv_id, x.depth::bigint as depth, p.conv_id as parent_conv_id, x.n_convs, coalesce(k.n_children, 0) as n_children, b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from nodes x join below b on b.above = x.node left join kids k on k.above = x.node left join ends e on e.node = x.node left join up on up.node = x.node and up.above_depth = x.depth - 1 left join nodes p on p.node = up.above"""


def oracle_sql() -> dict[str, str]:
    """Of the others, byte strings, models, packing and features are not SQL; tests compare with brute force."""
    return {"op1_ngram_join": _OP1, "op3_license_scan": scan_sql(), "op8_decontamination": _OP8, "op10_substring_dedup": _OP10, "op11_mixing": _OP11, "op13_conversation_trie": _OP13}
