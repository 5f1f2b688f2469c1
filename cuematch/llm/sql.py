"""SQL partners of the check queries that SQL can express, written from the rules."""

from __future__ import annotations

PSTABLE_DUPLICATES = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n from link group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, least.component_id, e.vec_id = least.component_id as kept
from embeddings e join least on least.a = e.vec_id left join n on n.a = e.vec_id"""

JACCARD_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [hash(w)]
  else list_transform(range(1, len(w) - 3), lambda i: hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4])) end)) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least.component_id
from documents d join least on least.a = d.doc_id left join n on n.doc_id = d.doc_id"""

REPEATED_BYTES = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
block as (  -- substr walks from the start of its text, so windows are cut from short blocks
  select doc_id, n, j, substr(h, 1000 * j + 1, 1400) as h from (select doc_id, h, n, unnest(range(0, n // 500 + 1)) as j from d)),
w as (select doc_id, 500 * j + i as i, hash(substr(h, 2 * i - 1, 400)) as k
  from (select doc_id, h, n, j, unnest(range(1, 501)) as i from block) where 500 * j + i <= n - 199),
s as (select doc_id, i from (select *, count(*) over (partition by k) as c from w) where c > 1),
f as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as f from s),
g as (select doc_id, i, sum(f) over (partition by doc_id order by i) as g from f),
runs as (select doc_id, min(i) as a, max(i) + 200 as b from g group by doc_id, g),
pieces as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 1) as x, a as y from runs
  union all select d.doc_id, coalesce(max(b), 1), max(n) + 1 from d left join runs using (doc_id) group by d.doc_id),
kept as (select doc_id, string_agg(substr(h, 2 * x - 1, 2 * (y - x)), '' order by x) as kept from pieces join d using (doc_id) group by doc_id),
total as (select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans from runs group by doc_id)
select d.doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(kept)) as kept_sha256
from d join kept using (doc_id) left join total using (doc_id)"""

# crc32 by bytes; hex digits to numbers by a cast
_CRC = """
crc as (select list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda a, x:
  case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc)"""


def _crc32(text: str) -> str:
    byte = f"list_transform(range(0, strlen({text})), lambda i: cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce([4294967295] || {byte}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


MERKLE_MANIFEST = rf"""
with recursive {_CRC.strip()},
d as (
  select doc_id, source, {_leaf("text")} as leaf,
    {_leaf("case when mod(" + _crc32("cast(doc_id as varchar)") + ", 2) = 0 then replace(text, chr(10), '') else text end")} as changed,
    row_number() over (partition by source order by doc_id) - 1 as i
  from documents, crc),
node as (
  select source, 0 as level, i, leaf as h from d
  union all
  select source, level + 1, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over (partition by source) as n from node) where n > 1 group by source, level, i // 3),
subroot as (
  select source, h, height, row_number() over (order by source nulls first) - 1 as i
  from (select source, arg_max(h, level) as h, max(level) as height from node group by source)),
top as (
  select 0 as level, i, h from subroot
  union all
  select level + 1, i // 3, sha256(string_agg(h, '' order by i))
  from (select *, count(*) over () as n from top) where n > 1 group by level, i // 3),
root as (select arg_max(h, level) as h, max(level) as height from top),
power as (select level, cast(pow(3, level) as bigint) as p from (select unnest(range(30)) as level)),
step as (
  select d.doc_id, n.level as step, n.i < d.i // p as is_left, n.h, n.i
  from d join node n on n.source is not distinct from d.source join power on power.level = n.level
  join subroot s on s.source is not distinct from d.source
  where n.level < s.height and n.i // 3 = d.i // p // 3 and n.i <> d.i // p
  union all
  select d.doc_id, s.height + n.level, n.i < s.i // p, n.h, n.i
  from d join subroot s on s.source is not distinct from d.source, top n join power on power.level = n.level, root
  where n.level < root.height and n.i // 3 = s.i // p // 3 and n.i <> s.i // p),
proof as (select doc_id, sha256(string_agg(h, '' order by step, i)) as proof from step group by doc_id),
beside as (
  select doc_id, step, coalesce(string_agg(h, '' order by i) filter (is_left), '') as a, coalesce(string_agg(h, '' order by i) filter (not is_left), '') as z
  from step group by doc_id, step),
folded as (
  select d.doc_id, 0 as step, d.changed as h, s.height + root.height as steps from d join subroot s on s.source is not distinct from d.source, root
  union all
  select f.doc_id, f.step + 1, sha256(coalesce(b.a, '') || f.h || coalesce(b.z, '')), f.steps
  from folded f left join beside b on b.doc_id = f.doc_id and b.step = f.step where f.step < f.steps)
select d.doc_id, d.leaf, s.h as subroot, root.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = root.h as verified
from d join subroot s on s.source is not distinct from d.source join folded f on f.doc_id = d.doc_id and f.step = f.steps
left join proof p on p.doc_id = d.doc_id, root"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TARGET_RESAMPLE = f"""
with {_CRC.strip()},
d as (select doc_id, {_WORDS} as w from documents),
f as (select doc_id, unnest(w) as word from d),
g as (select unnest({_WORDS}) as word from benchmark),
code as (select word, mod({_crc32("word")}, 10000) as bucket from (select word from f union select word from g), crc),
s as (select bucket, count(*) as s from f join code using (word) group by bucket),
t as (select bucket, count(*) as t from g join code using (word) group by bucket),
total as (select (select count(*) from f) as ss, (select count(*) from g) as tt),
gain as (
  select bucket, cast(floor(1000 * ln(cast((coalesce(t, 0) + 1) * (ss + 10000) as double) / cast((coalesce(s, 0) + 1) * (tt + 10000) as double))) as bigint) as gain
  from (select distinct bucket from code) left join s using (bucket) left join t using (bucket), total),
w as (select doc_id, cast(sum(gain) as bigint) as weight from f join code using (word) join gain using (bucket) group by doc_id),
h as (select doc_id, len(w) as n, cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) as h from d),
scored as (
  select doc_id, n, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((h + cast(0.5 as double)) / cast(4294967296 as double)))) as bigint) as score
  from h left join w using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as able from scored where n >= 20)
select scored.doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
  cast(case when r <= 10 * able // 100 then r end as bigint) as rank
from scored left join ranked using (doc_id)"""

SQL: dict[str, str] = {
    "op1_pstable_duplicates": PSTABLE_DUPLICATES,
    "op2_jaccard_join": JACCARD_JOIN,
    "op8_repeated_bytes": REPEATED_BYTES,
    "op11_merkle_manifest": MERKLE_MANIFEST,
    "op12_target_resample": TARGET_RESAMPLE,
}
