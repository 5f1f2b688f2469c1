"""The stand-in relations and every check query as DuckDB SQL.

Written from the rules, apart from the Spark code: windows and joins here
where the library works on arrays inside a row.
"""

from __future__ import annotations

from checks.standins import C, E, K, N, P, PROMPTS, R, S, T, TRACK_BASE, V
from cuematch import fixed_values as fv
from cuematch.sources.taxonomy import tag_rows


def lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def pick(words, n: str) -> str:
    return f"list_extract({lit_list(words)}, cast(({n}) % {len(words)} + 1 as int))"


def picks(words, *ns: str) -> str:
    return "[" + ", ".join(pick(words, n) for n in ns) + "]"


def d(x: float) -> str:
    return f"cast({x!r} as double)"


def half_up(x: str, digits: int) -> str:
    """Rounded half up, free of binary noise: first to 12 places as a decimal."""
    return f"(cast(round(cast({x} as decimal(38, 12)), {digits}) as double) + 0.0)"


def half_up3(x: str) -> str:
    """Rounded half up on the printed decimal of the double, as a report does."""
    return f"(cast(round(cast(cast({x} as varchar) as decimal(38, 20)), 3) as double) + 0.0)"


def r6(x: str) -> str:
    return half_up(x, 6)


SCENES = f"""
fx_e as (select *, list_concat(list_slice(embedding, 33, 64), list_slice(embedding, 1, 32)) as w from embeddings),
fx_s as (
  select vec_id as id,
    vec_id // 20 + 1 as episode_nr, (vec_id % 20) // 2 + 1 as scene_nr, vec_id % 2 + 1 as theme_nr,
    'Reason ' || vec_id as segmentation_reason, 'Temat ' || vec_id as theme_title_pl,
    case when vec_id % 13 = 12 then '' else 'Theme ' || vec_id end as theme_title_en,
    'Scene ' || vec_id as description_en, 'Text ' || vec_id as theme_txt, 'Tags ' || vec_id as tags_summary_en,
    {picks(V, 'vec_id', '3*vec_id+1')} as emotion, {picks(N, 'vec_id')} as narrative,
    {pick(P, 'vec_id')} as profile, vec_id % 3 = 0 as dialogue,
    {pick(E, 'vec_id')} as energy, {pick(T, '2*vec_id')} as tempo, {pick(R, 'vec_id')} as rhythm,
    {pick(S, 'vec_id')} as shape, {picks(C, 'vec_id', 'vec_id+2')} as sound,
    {picks(V, '7*vec_id', '7*vec_id+3', '7*vec_id+8')} as should,
    {picks(V, '11*vec_id+4', '11*vec_id+9')} as must_not,
    list_slice(w, 1, 32) as e_main, list_slice(w, 33, 64) as e_tags, list_slice(w, 17, 48) as e_ens, w as e_hyb
  from fx_e)"""
TRACKS = f"""
fx_t as (
  select vec_id + {TRACK_BASE} as id, 'cue_' || lpad(cast(vec_id as varchar), 5, '0') || '.mp3' as filename,
    'lib/' || label || '/cue_' || lpad(cast(vec_id as varchar), 5, '0') || '.mp3' as filepath,
    cast((vec_id % 40) * 6 as double) as duration_sec,
    case when vec_id % 11 <> 0 then 50 + (7 * vec_id) % 110 end as bpm, {pick(K, 'vec_id')} as musical_key,
    'Cue ' || vec_id as semantic_title_en, 'Track ' || vec_id as description_en, 'Summary ' || vec_id as tags_summary_en,
    {picks(V, '5*vec_id+label', 'vec_id+2', '9*vec_id')} as emotion, {picks(N, 'vec_id+label', 'vec_id+1')} as narrative,
    [{pick(P, 'label % 3')}, {pick(P, 'vec_id+2')}] as profiles, vec_id % 5 < 2 as safe,
    {pick(E, '2*(label % 3)')} as energy, {pick(T, 'label % 2')} as tempo, {pick(R, 'vec_id')} as rhythm,
    {pick(S, 'label % 3')} as shape, {picks(C, 'label % 2', 'label % 2 + 1', 'label % 2 + 3', 'vec_id')} as sound,
    {picks(V, '3*vec_id', '3*vec_id+4', 'label+6', 'vec_id+13')} as should,
    {picks(V, '13*vec_id+1', '13*vec_id+7')} as must_not,
    list_reverse(embedding) as e_audio, list_slice(embedding, 1, 32) as e_main, list_slice(embedding, 33, 64) as e_tags,
    list_slice(embedding, 17, 48) as e_ens, case when vec_id % 97 <> 0 then embedding end as e_hyb
  from embeddings)"""
BOTH = SCENES + "," + TRACKS


def cos(a: str, b: str) -> str:
    return f"list_cosine_similarity(cast({a} as double[]), cast({b} as double[]))"


def knn(name: str, vec: str, k: int) -> str:
    return f"""
{name} as (
  select sid, tid, dist, rk from (
    select s.id as sid, t.id as tid, 1 - {cos('s.' + vec, 't.' + vec)} as dist,
      row_number() over (partition by s.id order by 1 - {cos('s.' + vec, 't.' + vec)} asc nulls last, t.id) as rk
    from fx_s s, fx_t t) where rk <= {k})"""


UNION = """
cand as (
  select sid, tid, place from (
    select sid, tid, row_number() over (partition by sid order by src, rk) as place from (
      select sid, tid, min_by(src, src * 1000 + rk) as src, min_by(rk, src * 1000 + rk) as rk
      from (select sid, tid, rk, 0 as src from hyb union all select sid, tid, rk, 1 as src from ens)
      group by sid, tid))
  where place <= 180)"""
CANDIDATES = BOTH + "," + knn("hyb", "e_hyb", 150) + "," + knn("ens", "e_ens", 60) + "," + UNION
SAME_ROW = BOTH + f",\ncand as (select s.id as sid, t.id as tid from fx_s s join fx_t t on t.id = s.id + {TRACK_BASE})"


def inter(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b})))"


def share(a: str, b: str) -> str:
    return f"cast({inter(a, b)} as double) / len(list_distinct({a}))"


def ordinal(a: str, b: str, scale) -> str:
    pa, pb = f"list_position({lit_list(scale)}, {a})", f"list_position({lit_list(scale)}, {b})"
    return f"case when {a} = {b} then {d(1.0)} else greatest({d(0.0)}, 1 - {d(0.25)} * abs({pa} - {pb})) end"


def clamp(x: str) -> str:
    return f"greatest({d(0.0)}, least({d(1.0)}, {x}))"


def issue_count(side: str) -> str:
    overlap = f"(case when {inter(side + '.should', side + '.must_not')} > 0 then 1 else 0 end)"
    missing = f"(case when {side}.e_hyb is null then 1 else 0 end)"
    title = "theme_title_en" if side == "s" else "semantic_title_en"
    blank = f"(case when {side}.{title} = '' then 1 else 0 end)"
    return f"{overlap} + {missing} + {blank}"


W = fv.SCORE_WEIGHTS
SCORED = f"""
parts as (
  select s.episode_nr, s.scene_nr, s.theme_nr, s.id as sid, t.id as tid, s.theme_title_en, t.semantic_title_en,
    s.description_en as s_description, t.description_en as t_description, t.tags_summary_en as t_summary,
    t.filename, t.filepath, t.duration_sec, t.bpm, t.musical_key, s.dialogue,
    {cos('s.e_main', 't.e_main')} as main_similarity, {cos('s.e_tags', 't.e_tags')} as tags_similarity,
    {cos('s.e_ens', 't.e_ens')} as ensemble_similarity, {cos('s.e_hyb', 't.e_hyb')} as hybrid_similarity,
    {cos('s.e_hyb', 't.e_audio')} as audio_similarity_aux,
    {share('s.emotion', 't.emotion')} as emotion_match_score, {share('s.narrative', 't.narrative')} as narrative_match_score,
    case when list_contains(t.profiles, s.profile) then {d(1.0)} else {d(0.0)} end as weight_profile_match_score,
    case when s.dialogue and not t.safe then {d(0.0)} else {d(1.0)} end as dialogue_score,
    {ordinal('s.energy', 't.energy', E)} as energy_match_score, {ordinal('s.tempo', 't.tempo', T)} as tempo_match_score,
    case when s.rhythm = t.rhythm then {d(1.0)} else {d(0.0)} end as rhythm_match_score,
    {ordinal('s.shape', 't.shape', S)} as intensity_shape_match_score,
    cast({inter('s.sound', 't.sound')} as double) / len(list_distinct(list_concat(s.sound, t.sound))) as sound_character_match_score,
    {share('s.should', 't.should')} as should_have_hit_rate, {share('s.must_not', 't.should')} as must_not_conflict_rate,
    case when s.dialogue and not t.safe then {d(0.20)} else {d(0.0)} end as dialogue_conflict,
    case when t.duration_sec <= 0 then {d(0.10)} when t.duration_sec < 30 then {d(0.15)}
         when t.duration_sec < 60 then {d(0.05)} else {d(0.0)} end as duration_conflict,
    least({d(0.25)}, {d(0.08)} * {inter('s.must_not', 't.should')}) as forbidden_tag_conflict,
    case when {issue_count('s')} + {issue_count('t')} = 0 then {d(0.0)}
      else least({d(0.25)}, greatest({d(0.05)}, {d(0.02)} * ({issue_count('s')} + {issue_count('t')}))) end as missing_data_penalty,
    t.profiles[1] || '|' || t.energy || '|' || t.tempo || '|' || t.shape || '|'
      || array_to_string(list_sort(list_slice(t.sound, 1, 3)), '-') as style_signature
  from cand c join fx_s s on s.id = c.sid join fx_t t on t.id = c.tid
  where t.e_hyb is not null),
scores as (
  select *,
    {clamp(f"({d(.15)} * main_similarity + {d(.10)} * tags_similarity + {d(.20)} * ensemble_similarity + {d(.50)} * hybrid_similarity + {d(.05)} * audio_similarity_aux) / {d(sum(W['embedding'].values()))}")} as embedding_score,
    {clamp(f"{d(.35)} * emotion_match_score + {d(.25)} * narrative_match_score + {d(.20)} * weight_profile_match_score + {d(.20)} * dialogue_score")} as semantic_score,
    {clamp(f"{d(.20)} * energy_match_score + {d(.20)} * tempo_match_score + {d(.15)} * rhythm_match_score + {d(.20)} * intensity_shape_match_score + {d(.25)} * sound_character_match_score")} as targets_score,
    {clamp(f"{d(.75)} * should_have_hit_rate - {d(.25)} * must_not_conflict_rate")} as tag_selection_score
  from parts),
scored as (
  select *, {d(.40)} * embedding_score + {d(.25)} * semantic_score + {d(.20)} * targets_score + {d(.15)} * tag_selection_score as weighted
  from scores)"""

RANK_KEYS = "embedding_score desc, semantic_score desc, targets_score desc, hybrid_similarity desc, tid"
ALONE = f"""
alone as (
  select *, row_number() over (partition by sid order by final_score desc, {RANK_KEYS}) as rank_position from (
    select *, dialogue_conflict + duration_conflict + forbidden_tag_conflict + missing_data_penalty as penalty_total,
      {clamp('weighted - (dialogue_conflict + duration_conflict + forbidden_tag_conflict + missing_data_penalty)')} as final_score
    from scored))"""

FOLD = f"""
steps as (
  select *, dense_rank() over (partition by episode_nr order by scene_nr, theme_nr, sid) as step from scored),
fold as (
  select episode_nr, cast(0 as bigint) as step, cast(-1 as bigint) as won, cast([] as varchar[]) as styles
  from (select distinct episode_nr from steps)
  union all
  select episode_nr, step, first(tid order by fin desc, {RANK_KEYS}),
    list_append(any_value(styles), first(style_signature order by fin desc, {RANK_KEYS}))
  from (
    select s.*, f.styles,
      {clamp(f"weighted - (dialogue_conflict + duration_conflict + forbidden_tag_conflict + {d(.10)} * greatest(0, len(list_filter(f.styles, lambda x: x = s.style_signature)) - 1) + (case when s.tid = f.won then {d(.12)} else {d(0.0)} end) + missing_data_penalty)")} as fin
    from fold f join steps s on s.episode_nr = f.episode_nr and s.step = f.step + 1)
  group by episode_nr, step),
placed as (
  select s.*,
    {d(.10)} * greatest(0, len(list_filter(f.styles, lambda x: x = s.style_signature)) - 1) as style_redundancy_penalty,
    case when s.tid = f.won then {d(.12)} else {d(0.0)} end as same_track_consecutive_penalty
  from steps s join fold f on f.episode_nr = s.episode_nr and f.step = s.step - 1),
finals as (
  select *, {clamp('weighted - penalty_total')} as final_score from (
    select *, dialogue_conflict + duration_conflict + forbidden_tag_conflict + style_redundancy_penalty
      + same_track_consecutive_penalty + missing_data_penalty as penalty_total from placed)),
matches as (
  select * from (
    select *, row_number() over (partition by sid order by final_score desc, {RANK_KEYS}) as rank_position from finals)
  where rank_position <= 10)"""

RANKED = "with recursive " + CANDIDATES + "," + SCORED + "," + FOLD

COMPONENTS = ["main_similarity", "tags_similarity", "ensemble_similarity", "hybrid_similarity", "audio_similarity_aux",
              "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "dialogue_score"]
STATIC_PENALTIES = ["dialogue_conflict", "duration_conflict", "forbidden_tag_conflict", "missing_data_penalty"]
PENALTIES = ["dialogue_conflict", "duration_conflict", "forbidden_tag_conflict", "style_redundancy_penalty",
             "same_track_consecutive_penalty", "missing_data_penalty", "penalty_total"]


def rounded(columns, prefix: str = "") -> str:
    return ", ".join(f"{r6(prefix + c)} as {c}" for c in columns)


IDS = "sid as scene_query_id, tid as track_query_id"
PLACE = "episode_nr, scene_nr, theme_nr"

# --- tags --------------------------------------------------------------------

_TAGS = ", ".join(f"({no}, '{category}', '{name}')" for no, category, name in tag_rows())
_RULES = ", ".join(
    f"('{c}', {k}, {d(t)}, {d(m)}, {q})" for c, (k, t, m, q) in fv.CATEGORY_RULES.items()
)
_HINTS = ", ".join(
    f"({i}, '{p}', '{t}')" for i, (p, tags) in enumerate(fv.PROFILE_HINTS.items()) for t in tags
)
_CONTRARY = ", ".join(
    f"('{t}', {i}, '{o}')" for t, others in fv.CONTRARY_TAGS.items() for i, o in enumerate(others)
)
_COEF = ", ".join(
    [f"('{t}', {d(c)})" for t, c in fv.DIALOGUE_SAFE.items()] + [f"('{t}', {d(-c)})" for t, c in fv.DIALOGUE_RISK.items()]
)
TAG_SELECT = f"""
tags(n, category, name) as (values {_TAGS}),
rules(category, top_k, thr, margin, required) as (values {_RULES}),
fx_g as (
  select vec_id + {TRACK_BASE} as id, n, category, name,
    {d(0.15)} + cast((31 * vec_id + 17 * n + vec_id * n) % 139 as double) / {d(1150.0)} as score
  from embeddings, tags),
g_ranked as (
  select *, row_number() over w - 1 as i, coalesce(lead(score) over w, -1) as next
  from fx_g window w as (partition by id, category order by score desc, n)),
g_kept as (
  select g.*, r.thr, r.required from g_ranked g join rules r using (category)
  where i < top_k and score >= thr and (score - next >= margin or i < required or score >= thr + {d(0.035)})),
sel0 as (
  select id, n, category, name, score from g_kept
  union all
  select g.id, g.n, g.category, g.name, g.score from g_ranked g join rules r using (category)
  where g.i = 0 and r.required > 0 and g.score >= r.thr - {d(0.020)}
    and not exists (select 1 from g_kept k where k.id = g.id and k.category = g.category)),
sel as (select *, row_number() over (partition by id order by score desc, n) as pos from sel0),
lookup as (select id, name, min(score) as score from sel group by id, name),
ids as (select vec_id + {TRACK_BASE} as id from embeddings),
coef(name, c) as (values {_COEF}),
safe as (
  select ids.id, {clamp(f"{d(0.50)} + coalesce(sum(coef.c * l.score), 0)")} as t3
  from ids left join lookup l on l.id = ids.id left join coef on coef.name = l.name group by ids.id)"""
TAG_PROFILES = f"""
hints(no, profile, name) as (values {_HINTS}),
prof as (
  select l.id, h.no, h.profile, sum(l.score) + case when h.profile = 'dialogue' then {d(0.45)} * any_value(s.t3) else 0 end as score
  from lookup l join hints h using (name) join safe s on s.id = l.id group by l.id, h.no, h.profile),
good as (select * from prof where score >= {d(0.24)}),
best as (select id, max(score) as top from good group by id),
near as (
  select g.id, g.profile, row_number() over (partition by g.id order by g.score desc, g.no) as rk
  from good g join best b using (id) where g.score >= greatest({d(0.24)}, b.top - {d(0.12)})),
cands as (
  select ids.id, case
    when n.listed is not null then n.listed
    when s.t3 >= {d(0.62)} then ['dialogue', 'transition']
    when c.listed is not null then c.listed else ['dramatic_scene'] end as profiles
  from ids join safe s using (id)
  left join (select id, list(profile order by rk) as listed from near where rk <= 3 group by id) n using (id)
  left join (select id, list(name order by pos) as listed from (
      select *, row_number() over (partition by id order by pos) as k from sel where category = 'scene') where k <= 2 group by id) c using (id)),
by_cat as (select *, row_number() over (partition by id, category order by pos) as k from sel),
sem as (
  select c.id, c.profiles, s.t3, round(s.t3, 6) as t3r, s.t3 >= {d(0.60)} as safe,
    coalesce((select list(name order by k) from by_cat b where b.id = c.id and category = 'emotion' and k <= 4), []) as emotion,
    coalesce((select list(name order by k) from by_cat b where b.id = c.id and category = 'narrative' and k <= 3), ['underscore']) as narrative
  from cands c join safe s using (id)),
sound0 as (
  select ids.id, coalesce((select list(name order by k) from by_cat b where b.id = ids.id and category = 'sound_character' and k <= 4), ['atmospheric']) as s from ids),
tgt as (
  select ids.id,
    coalesce((select name from by_cat b where b.id = ids.id and category = 'energy' and k = 1), 'medium') as energy,
    coalesce((select name from by_cat b where b.id = ids.id and category = 'tempo' and k = 1), 'moderate') as tempo,
    coalesce((select name from by_cat b where b.id = ids.id and category = 'rhythm' and k = 1), 'steady') as rhythm,
    coalesce((select name from by_cat b where b.id = ids.id and category = 'intensity_shape' and k = 1), 'static') as shape,
    case when list_contains(s, 'atmospheric') or len(s) >= 4 then s else list_append(s, 'atmospheric') end as sound
  from ids join sound0 using (id))"""
TAG_BANS = f"""
contrary(tag, no, other) as (values {_CONTRARY}),
bans(profile, no, other) as (values {", ".join(f"('{p}', {i}, '{o}')" for p, tags in fv.PROFILE_BANS.items() for i, o in enumerate(tags))}),
loud(no, other) as (values {", ".join(f"({i}, '{o}')" for i, o in enumerate(fv.LOUD_TAGS))}),
found as (
  select s.id, c.other, greatest({d(0.20)}, l.score) as value, s.pos * 100 + c.no as place
  from sel s join contrary c on c.tag = s.name join lookup l on l.id = s.id and l.name = s.name
  union all
  select m.id, l.other, {d(0.50)} + {d(0.30)} * m.t3r, 1000000 + l.no from sem m, loud l where m.t3r >= {d(0.62)}
  union all
  select m.id, b.other, {d(0.42)}, 2000000 + p.i * 100 + b.no
  from (select id, unnest(profiles[1:2]) as profile, generate_subscripts(profiles[1:2], 1) as i from sem) p
  join bans b using (profile) join sem m on m.id = p.id
  union all
  select t.id, c.other, {d(0.30)}, 3000000 + t.i * 100 + c.no
  from (select id, energy as tag, 0 as i from tgt union all select id, tempo, 1 from tgt) t join contrary c using (tag)),
banned as (
  select f.id, f.other, max(value) as value, min(place) as place from found f
  where not exists (select 1 from lookup l where l.id = f.id and l.name = f.other) group by f.id, f.other),
must as (
  select ids.id, coalesce(b.listed, []) as must_not from ids left join (
    select id, list(other order by rk) as listed from (
      select *, row_number() over (partition by id order by value desc, place) as rk from banned) where rk <= 6 group by id) b using (id)),
picked as (
  select ids.id, coalesce(s.names, []) as names, coalesce(s.mean, 0) as mean, coalesce(s.hi, 0) as hi, coalesce(s.lo, 0) as lo
  from ids left join (select id, list(name order by pos) as names, avg(score) as mean, max(score) as hi, min(score) as lo from sel group by id) s using (id)),
texts as (
  select p.id, m.emotion, m.narrative, t.energy, t.shape, t.sound, p.names,
    case when len(m.emotion) > 0 then m.emotion else ['cinematic'] end as emo
  from picked p join sem m using (id) join tgt t using (id)),
texts2 as (
  select *,
    array_to_string(list_transform(string_split(replace(emo[1], '_', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || ' '
      || array_to_string(list_transform(string_split(replace(narrative[1], '_', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') || ' Cue' as title,
    'Instrumental cue with ' || replace(array_to_string(emo[1:2], ', '), '_', ' ') || ' and '
      || replace(array_to_string(narrative[1:2], ', '), '_', ' ') || '; ' || replace(energy, '_', ' ') || ' energy, '
      || replace(shape, '_', ' ') || ' shape, ' || replace(array_to_string(sound[1:2], ', '), '_', ' ') || ' character.' as description,
    case when len(names) > 0 then replace(array_to_string(names[1:6], ', '), '_', ' ') else 'cinematic instrumental underscore' end as summary
  from texts)"""
TAGS1 = "with " + TAG_SELECT
TAGS2 = TAGS1 + "," + TAG_PROFILES
TAGS3 = TAGS2 + "," + TAG_BANS


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


def mean_of(columns) -> str:
    return ", ".join(f"{r6(f'avg({c})')} as avg_{c}" for c in columns)


def weighted_vec(parts: list[str], weights: list[float]) -> str:
    """Per position sum of weights; parts are list expressions of equal length."""
    total = " + ".join(f"{d(w)} * cast({p}[i] as double)" for p, w in zip(parts, weights))
    return f"list_transform(range(1, len({parts[0]}) + 1), lambda i: ({total}) / {d(float(sum(weights)))})"


def unit_rows(vec_sql: str, key: str) -> str:
    return f"""
select {key}, pos, {r6('x / nullif(sqrt(sum(x * x) over (partition by ' + key + ')), 0)')} as value
from (select {key}, unnest(v) as x, generate_subscripts(v, 1) as pos from ({vec_sql}))"""


SCORES6 = ["final_score", "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "dialogue_score"]
FULL = ["final_score", *COMPONENTS[5:], *COMPONENTS[:5], *PENALTIES]


def _existing_tracks() -> str:
    return f"""
old as (
  select doc_id + 5000000 as id, 'old_' || doc_id as filename,
    'lib/' || (doc_id % 10) || '/cue_' || lpad(cast(doc_id as varchar), 5, '0') || '.mp3' as filepath,
    cast(n_chars as double) as duration_sec, 'Old ' || doc_id as semantic_title_en
  from documents)"""


_STRIP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
HEADER = r"^\s*(?:The|Les?|La|Die|Der|Das|El|Los|In|En)\s+(.*)$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_STRIP}+|{_STRIP}+$', '', 'g')"


def whitespace_sql(x: str) -> str:
    a = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    b = rf"regexp_replace({a}, '[ \t]+', ' ', 'g')"
    c = rf"regexp_replace({b}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip_sql(c)


def token_rows(source: str, key: str, text: str, dim: int) -> str:
    """(key, bucket, cnt) word counts of the hashing encoder."""
    return f"""
select {key}, ('0x' || substr(md5(w), 1, 8))::ubigint % {dim} as bucket, cast(count(*) as double) as cnt
from (select {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) as w from {source}) group by all"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    # vectors
    q["cosine"] = f"""with {BOTH} select s.id, {r6(cos('s.e_hyb', 't.e_audio'))} as similarity,
      {r6('coalesce(' + cos('s.e_hyb', 't.e_hyb') + ', 0)')} as hybrid_similarity,
      {r6('1 - ' + cos('s.e_hyb', 't.e_hyb'))} as distance
      from fx_s s join fx_t t on t.id = s.id + {TRACK_BASE}"""
    q["l2_normalize"] = unit_rows("select vec_id as id, list_transform(embedding, lambda x: cast(x as double) * 3) as v from embeddings", "id")
    ens_parts = [f"list_slice(list_concat(embedding, embedding), {5 * i + 1}, {5 * i + 64})" for i in range(7)]
    q["ensemble_vector"] = unit_rows(
        f"select vec_id as id, {weighted_vec(ens_parts, list(fv.ENSEMBLE_PROMPTS.values()))} as v from embeddings", "id")
    q["hybrid_vector"] = unit_rows(
        f"with {SCENES} select id, {weighted_vec(['e_main', 'e_tags', 'e_ens'], list(fv.HYBRID_WEIGHTS.values()))} as v from fx_s", "id")
    q["tag_vector"] = unit_rows(
        f"select vec_id as id, {weighted_vec(ens_parts[:3], fv.TAG_PROMPT_WEIGHTS)} as v from embeddings", "id")
    q["vector_decode"] = f"""select id, pos, {r6('x')} as value from (
      select vec_id as id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings)"""
    q["mean_pool"] = f"""select filepath, n_segments, pos, {r6('x / sqrt(sum(x * x) over (partition by filepath))')} as value from (
      select filepath, any_value(n) as n_segments, pos, avg(x) as x from (
        select cast(label as varchar) as filepath, count(*) over (partition by label) as n, cast(x as double) as x, pos
        from (select label, vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings))
      group by filepath, pos)"""
    # the window above counts exploded rows, so divide by the vector length
    q["mean_pool"] = q["mean_pool"].replace("any_value(n) as n_segments", "any_value(n) // 64 as n_segments")
    # retrieval
    q["knn_hybrid"] = f"with {BOTH},{knn('hyb', 'e_hyb', 150)} select sid as query_id, tid as item_id, {r6('dist')} as distance, rk as rank from hyb"
    q["knn_cells"] = q["knn_floors"] = q["knn_hybrid"]
    q["knn_ensemble"] = f"with {BOTH},{knn('ens', 'e_ens', 60)} select sid as query_id, tid as item_id, {r6('dist')} as distance, rk as rank from ens"
    ragged = f"case when x.vec_id % 3 = 1 then 1.0 else 1 - {cos('s.embedding', 'x.embedding')} end"
    q["knn_ragged"] = f"""select query_id, item_id, {r6('dist')} as distance, rank from (
      select s.vec_id as query_id, x.vec_id + {TRACK_BASE} as item_id, {ragged} as dist,
        row_number() over (partition by s.vec_id order by {ragged}, x.vec_id) as rank from embeddings s, embeddings x) where rank <= 20"""
    q["candidate_union"] = f"with {CANDIDATES} select {IDS}, place from cand"
    # scores of the pair (scene v, track v)
    same = f"with {SAME_ROW},{SCORED} select {IDS}, "
    q["embedding_score"] = same + rounded(COMPONENTS[:6]) + " from scored"
    q["set_overlap"] = same + rounded(["emotion_match_score", "narrative_match_score", "weight_profile_match_score", "dialogue_score"]) + " from scored"
    q["semantic_score"] = same + rounded(["semantic_score"]) + " from scored"
    q["ordinal_match"] = same + rounded(["energy_match_score", "tempo_match_score", "rhythm_match_score", "intensity_shape_match_score"]) + " from scored"
    q["jaccard"] = same + rounded(["sound_character_match_score"]) + " from scored"
    q["targets_score"] = same + rounded(["targets_score"]) + " from scored"
    q["tag_score"] = same + rounded(["should_have_hit_rate", "must_not_conflict_rate", "tag_selection_score"]) + " from scored"
    q["penalties_static"] = same + rounded(STATIC_PENALTIES) + ", dialogue as dialogue_safe_applied from scored"
    q["style_signature"] = f"with {SAME_ROW},{SCORED} select tid as track_query_id, style_signature from scored"
    groups = {
        "embedding": COMPONENTS[:6],
        "semantic": ["emotion_match_score", "narrative_match_score", "weight_profile_match_score", "dialogue_match_score", "semantic_score"],
        "targets": ["energy_match_score", "tempo_match_score", "rhythm_match_score", "intensity_shape_match_score", "sound_character_match_score", "targets_score"],
        "tag_selection": ["should_have_hit_rate", "must_not_conflict_rate", "tag_selection_score"],
        "penalties": PENALTIES,
    }
    cells = []
    for group, names in groups.items():
        for name in names:
            source = {"dialogue_match_score": "dialogue_score", "style_redundancy_penalty": d(0.0),
                      "same_track_consecutive_penalty": d(0.0)}.get(name, name)
            cells.append(f"select {IDS}, '{group}' as grp, '{name}' as component, {r6(source)} as value from alone")
    four = lambda c: f"round({c}, 4)"
    rebuilt = clamp(f"{d(.40)} * {four('embedding_score')} + {d(.25)} * {four('semantic_score')} + {d(.20)} * {four('targets_score')} + {d(.15)} * {four('tag_selection_score')} - {four('penalty_total')}")
    cells.append(f"select {IDS}, 'final' as grp, 'final_score' as component, {r6(rebuilt)} as value from alone")
    q["score_breakdown"] = f"with {SAME_ROW},{SCORED},{ALONE} " + " union all ".join(cells)
    # scores and ranks of all candidates
    q["static_scores"] = (f"with {CANDIDATES},{SCORED} select {PLACE}, {IDS}, "
                          + rounded(COMPONENTS + STATIC_PENALTIES) + f", style_signature, {r6('weighted')} as weighted_score from scored")
    q["rank_preview"] = (f"with {CANDIDATES},{SCORED},{ALONE} select {IDS}, rank_position, "
                         + rounded(["final_score", "embedding_score", "penalty_total"]) + " from alone where rank_position <= 5")
    q["episode_ranking"] = (f"{RANKED} select {PLACE}, {IDS}, rank_position, "
                            + rounded(["final_score", *COMPONENTS, *PENALTIES]) + ", style_signature, dialogue as dialogue_safe_applied from matches")
    q["episode_ranking_hashed"] = (f"{RANKED} select {PLACE}, {IDS}, rank_position, " + rounded(["final_score", "same_track_consecutive_penalty"]) + ", style_signature from matches").replace(
        f"vec_id + {TRACK_BASE} as id, 'cue_'", f"case when vec_id % 2 = 1 then -(vec_id + 5) else vec_id + {TRACK_BASE} end as id, 'cue_'")
    q["preview_rows"] = (f"{RANKED} select {IDS}, scene_nr, theme_nr, theme_title_en, filename as track_filename, semantic_title_en as track_semantic_title_en, rank_position, "
                         + rounded(["final_score", "embedding_score", "semantic_score", "targets_score", "tag_selection_score", "penalty_total"])
                         + ", style_signature from matches where rank_position <= 5")
    q["match_top1"] = (f"{RANKED} select {PLACE}, {IDS}, theme_title_en as scene_theme_title_en, s_description as scene_description_en, semantic_title_en as track_semantic_title_en, "
                       f"filename as track_filename, rank_position, " + rounded([*SCORES6, "penalty_total"]) + ", style_signature from matches where rank_position = 1")
    q["match_debug"] = (f"{RANKED} select {PLACE}, {IDS}, rank_position, theme_title_en as scene_theme_title_en, s_description as scene_description_en, "
                        "semantic_title_en as track_semantic_title_en, t_description as track_description_en, t_summary as track_tags_summary_en, "
                        + f"{r6('final_score')} as final_score, {r6('duration_sec')} as duration_sec, bpm, musical_key from matches")
    q["match_compare"] = (f"{RANKED} select {PLACE}, {IDS}, m.theme_title_en, s.tags_summary_en as scene_tags_summary_en, {joined('s.emotion')} as scene_emotions, "
                          f"{joined('t.emotion')} as track_emotions, s.energy as scene_energy, t.energy as track_energy, {joined('s.should')} as scene_tags, "
                          f"{joined('t.should')} as track_tags, {r6('final_score')} as final_score from matches m join fx_s s on s.id = m.sid join fx_t t on t.id = m.tid")
    q["match_compare"] = q["match_compare"].replace(f"select {PLACE},", "select m.episode_nr, m.scene_nr, m.theme_nr,")
    q["match_explanation"] = (f"{RANKED} select {IDS}, theme_title_en, filename, {r6('energy_match_score')} as energy_match_score, "
                              f"{r6('dialogue_score')} as dialogue_match_score, {r6('penalty_total')} as penalty_total, style_signature, tid as metadata_track from matches")
    q["episode_summary"] = f"""{RANKED} select episode_nr, count(*) as total_match_rows, count(distinct sid) as total_scene_themes,
      count(distinct tid) as distinct_tracks_used, {r6('max(final_score)')} as max_final_score, {r6('min(final_score)')} as min_final_score,
      {mean_of([*SCORES6, 'penalty_total'])} from matches group by episode_nr"""
    q["style_redundancy"] = f"""{RANKED} select {PLACE}, style_signature, count(*) as style_count,
      array_to_string(list(tid order by rank_position), '|') as track_query_ids, array_to_string(list(filename order by rank_position), '|') as track_filenames
      from matches group by {PLACE}, style_signature having count(*) > 1"""
    q["low_confidence_view"] = (f"{RANKED} select {PLACE}, {IDS}, rank_position, " + rounded([*SCORES6, "penalty_total"])
                                + f" from matches where final_score < {d(.45)} or semantic_score < {d(.40)} or targets_score < {d(.40)} or penalty_total > {d(.25)}")
    q["low_confidence"] = f"{RANKED} select {IDS}, rank_position, {r6('final_score')} as final_score from matches where final_score < {d(.45)}"
    q["run_summary"] = f"""{RANKED} select count(*) as match_count, {r6('avg(final_score)')} as avg_final_score, {r6('avg(embedding_score)')} as avg_embedding_score,
      (select count(*) from fx_s) as scene_count, (select count(*) from fx_s) as scenes_processed,
      (select count(*) from fx_s where id not in (select sid from scored)) as scene_without_candidates from matches"""
    full3 = ", ".join(f"{half_up3(c)} as {c}" for c in FULL)
    q["report_full"] = (f"{RANKED} select episode_nr, {IDS}, scene_nr, theme_nr, rank_position, theme_title_en as scene_theme_title_en, semantic_title_en as track_semantic_title_en, "
                        f"filename as track_filename, filepath as track_filepath, {full3}, style_signature, dialogue as dialogue_safe_applied from matches")
    q["report_short"] = f"""{RANKED} select {PLACE}, rank_position, theme_title_en as scene_theme_title_en, filename as track_filename,
      semantic_title_en as track_semantic_title_en, {half_up3('final_score')} as final_score from matches where rank_position <= 3"""
    q["report_order"] = f"{RANKED} select {PLACE}, {IDS}, theme_title_en as scene_theme_title_en, rank_position from matches"
    q["report_grouped"] = f"""{RANKED} select {PLACE}, theme_title_en as scene_theme_title_en, array_to_string(list(tid order by rank_position), '|') as track_query_ids
      from matches group by {PLACE}, theme_title_en"""
    # lookups
    q["theme_matches"] = f"{RANKED} select {IDS}, rank_position, filename as track_filename, {r6('final_score')} as final_score from matches where episode_nr = 3 and scene_nr = 2 and theme_nr = 1"
    q["episode_matches"] = f"{RANKED} select {PLACE}, {IDS}, rank_position, {r6('final_score')} as final_score, style_signature from matches where episode_nr = 4"
    q["episode_scenes"] = f"with {SCENES} select id, {PLACE}, theme_title_en, {joined('emotion')} as emotions from fx_s where episode_nr = 2"
    q["scene_by_place"] = f"with {SCENES} select id, {PLACE}, segmentation_reason, theme_title_pl from fx_s where episode_nr = 2 and scene_nr = 5 and theme_nr = 2"
    q["scene_by_id"] = f"with {SCENES} select id, {PLACE}, tags_summary_en from fx_s where id = 77"
    q["track_detail"] = f"with {TRACKS} select id, filename, filepath, duration_sec, bpm, musical_key, {joined('should')} as should_have from fx_t where id = {TRACK_BASE + 123}"
    q["track_inspection"] = f"""with {TRACKS} select id, filename, {r6('duration_sec / 1000')} as rms_mean, {r6('duration_sec / 3000')} as zcr_mean,
      case when bpm is null then '–' else 'v1' end as pipeline_version from fx_t"""
    q["tracks_by_ids"] = f"with {TRACKS} select id, filename from fx_t where id in (select doc_id + {TRACK_BASE} from labels)"
    q["track_views"] = f"with {TRACKS} select id as track_query_id, filename, filepath, semantic_title_en, energy, {joined('must_not')} as must_not from fx_t"
    search = "id, filepath, filename, duration_sec, bpm, musical_key, semantic_title_en, tags_summary_en"
    q["track_search"] = f"""with {TRACKS}
      select 'contains' as mode, {search} from fx_t where filename ilike '%10%' or semantic_title_en ilike '%10%'
      union all select 'prefix', {search} from fx_t where filename ilike 'CUE_001%'
      union all select 'tags', {search} from fx_t where list_has_all(should, ['calm', 'dark'])
      union all select 'both', {search} from fx_t where (filename ilike '%2_4%' or semantic_title_en ilike '%2_4%') and list_contains(should, 'hope')
      union all select 'all', {search} from fx_t"""
    q["distinct_lists"] = f"""with {SCENES} select 'episode' as kind, episode_nr as nr from (select distinct episode_nr from fx_s)
      union all select 'scene', scene_nr from (select distinct scene_nr from fx_s where episode_nr = 2)
      union all select 'theme', theme_nr from (select distinct theme_nr from fx_s where episode_nr = 2 and scene_nr = 3)"""
    q["episode_options"] = f"""with {SCENES}, m as (select distinct doc_id as episode_nr from labels)
      select episode_nr, m.episode_nr is not null as matched, 'Episode ' || e.episode_nr || case when m.episode_nr is not null then ' - matched' else '' end as label
      from (select distinct episode_nr from fx_s) e left join m using (episode_nr)"""
    q["row_counts"] = """select 'scenes' as table_name, count(*) as n_rows from embeddings union all
      select 'tracks', count(*) from documents union all select 'matches', 0"""
    q["telemetry"] = f"""with {SCENES}, f as (select distinct doc_id from labels) select count(*) as scene_count, count(*) as scenes_processed,
      count(*) filter (where f.doc_id is null) as scene_without_candidates from fx_s left join f on f.doc_id = fx_s.id"""
    # validation
    issue = lambda kind: f"""case when {inter('should', 'must_not')} > 0 then 'overlapping {kind} tags: [' ||
      array_to_string(list_transform(list_sort(list_intersect(list_distinct(should), list_distinct(must_not))), lambda x: '''' || x || ''''), ', ') || ']' end"""
    s_issues = f"list_filter([case when theme_title_en = '' then 'missing theme_title_en' end, {issue('scene')}], lambda x: x is not null)"
    t_issues = f"list_filter([case when e_hyb is null then 'missing embedding_hybrid' end, {issue('track')}], lambda x: x is not null)"
    q["scene_issues"] = f"with {SCENES} select id, len({s_issues}) as n_issues, {joined(s_issues)} as issues from fx_s"
    q["track_issues"] = f"with {TRACKS} select id, len({t_issues}) as n_issues, {joined(t_issues)} as issues from fx_t"
    q["validation_report"] = f"""with {BOTH},
      si as (select id, {PLACE}, {s_issues} as i from fx_s), ti as (select id, {t_issues} as i from fx_t),
      sx as (select {PLACE}, id, unnest(i) as x, generate_subscripts(i, 1) as k from si), tx as (select id, unnest(i) as x, generate_subscripts(i, 1) as k from ti)
      select (select count(*) from si) as scene_count, (select count(*) from ti) as track_count,
        (select sum(len(i))::bigint from si) as scene_issue_count, (select sum(len(i))::bigint from ti) as track_issue_count,
        (select string_agg(x, '|' order by {PLACE}, id, k) from (select * from sx order by {PLACE}, id, k limit 10)) as scene_issue_samples,
        (select string_agg(x, '|' order by id, k) from (select * from tx order by id, k limit 10)) as track_issue_samples"""
    q["episode_validation"] = f"""with {BOTH},
      si as (select id, {PLACE}, {s_issues} as i from fx_s where episode_nr = 2),
      near as (select t.id from fx_t t, (select * from fx_s where episode_nr = 2 order by scene_nr, theme_nr, id limit 1) s
        order by 1 - {cos('s.e_hyb', 't.e_hyb')} asc nulls last, t.id limit 20),
      ti as (select id, {t_issues} as i from fx_t where id in (select id from near)),
      sx as (select {PLACE}, id, unnest(i) as x, generate_subscripts(i, 1) as k from si), tx as (select id, unnest(i) as x, generate_subscripts(i, 1) as k from ti)
      select (select count(*) from si) as scene_count, (select count(*) from ti) as track_count, (select count(*) from fx_t) as track_query_rows,
        (select sum(len(i))::bigint from si) as scene_issue_count, (select sum(len(i))::bigint from ti) as track_issue_count,
        coalesce((select string_agg(x, '|' order by {PLACE}, id, k) from (select * from sx order by {PLACE}, id, k limit 10)), '') as scene_issue_samples,
        coalesce((select string_agg(x, '|' order by id, k) from (select * from tx order by id, k limit 10)), '') as track_issue_samples"""
    texts_of = " union all ".join(
        [f"select id, 0 as p, theme_title_pl || '. ' || description_en as txt from fx_s", "select id, 1, tags_summary_en from fx_s"]
        + [f"select id, {i + 2}, '{p} ' || id from fx_s" for i, p in enumerate(PROMPTS)]
    )
    weight = "case p " + " ".join(f"when {i + 2} then {d(w)}" for i, w in enumerate(fv.ENSEMBLE_PROMPTS.values())) + " end"
    as_float = lambda x: f"cast(cast({x} as float) as double)"
    q["scene_vectors"] = f"""with {SCENES}, txt as ({texts_of}), tok as ({token_rows('txt', 'id, p', 'txt', 64)}),
      pv as (select id, p, bucket, {as_float('cnt / sqrt(sum(cnt * cnt) over (partition by id, p))')} as x from tok),
      e0 as (select id, bucket, sum({weight} * x) as x from pv where p >= 2 group by id, bucket),
      ens as (select id, bucket, {as_float('x / sqrt(sum(x * x) over (partition by id))')} as x from e0),
      h0 as (select id, bucket, sum(x) as x from (
        select id, bucket, {d(.45)} * x as x from pv where p = 0 union all select id, bucket, {d(.20)} * x from pv where p = 1
        union all select id, bucket, {d(.35)} * x from ens) group by id, bucket),
      hyb as (select id, bucket, {as_float('x / sqrt(sum(x * x) over (partition by id))')} as x from h0),
      every as (select id, 'main' as kind, bucket, x from pv where p = 0 union all select id, 'tags', bucket, x from pv where p = 1
        union all select id, 'clap_ensemble', bucket, x from ens union all select id, 'hybrid', bucket, x from hyb)
      select id, kind, cast(bucket as bigint) as pos, {r6('x')} as value from every where abs(x) > 1e-6"""
    odd = " union all ".join(
        ["select id, 0 as p, 'Cue ' || v || '. Track ' || v as txt from k where v % 23 <> 5", "select id, 1, 'Summary' from k where v % 29 <> 7"]
        + [f"select id, {i + 2}, '{p} ' || v // 10 from k" + (" where v % 31 <> 11" if p == "emotion_prompt" else "") for i, p in enumerate(PROMPTS)]
    )
    good = "v % 23 <> 5 and v % 29 <> 7 and v % 31 <> 11"
    wordless = "'the encoder gave no usable vector for ''!!!'''"
    q["track_vectors"] = f"""with k as (select vec_id + {TRACK_BASE} as id, vec_id as v from embeddings), txt as ({odd}), tok as ({token_rows('txt', 'id, p', 'txt', 64)}),
      pv as (select id, p, bucket, {as_float('cnt / sqrt(sum(cnt * cnt) over (partition by id, p))')} as x from tok),
      whole as (select id from k where {good}),
      e0 as (select id, bucket, sum({weight} * x) as x from pv where p >= 2 and id in (select id from whole) group by id, bucket),
      ens as (select id, bucket, {as_float('x / sqrt(sum(x * x) over (partition by id))')} as x from e0),
      h0 as (select id, bucket, sum(x) as x from (
        select id, bucket, {d(.45)} * x as x from pv where p = 0 union all select id, bucket, {d(.20)} * x from pv where p = 1
        union all select id, bucket, {d(.35)} * x from ens) where id in (select id from whole) group by id, bucket),
      hyb as (select id, bucket, {as_float('x / sqrt(sum(x * x) over (partition by id))')} as x from h0),
      every as (select id, 'main' as kind, bucket, x from pv where p = 0 union all select id, 'tags', bucket, x from pv where p = 1
        union all select id, 'clap_ensemble', bucket, x from ens union all select id, 'hybrid', bucket, x from hyb)
      select id, kind, cast(bucket as bigint) as pos, {r6('x')} as value, cast(null as varchar) as error_type, cast(null as varchar) as error from every where abs(x) > 1e-6
      union all select id, 'main_text', null, null, 'EmptyText', 'main_text is empty' from k where v % 23 = 5
      union all select id, 'tags_text', null, null, 'NoVector', {wordless} from k where v % 29 = 7
      union all select id, 'emotion_prompt', null, null, 'ValueError', 'cannot read boom ' || v from k where v % 31 = 11"""
    q["usable_tracks"] = f"with {TRACKS} select id from fx_t where e_hyb is not null"
    q["constraint_report"] = f"""with {_existing_tracks()}, raw as (
        select doc_id, case when doc_id % 7 = 0 then '{{"should_have_tags":[]}}' when doc_id % 7 = 1 then '{{"should_have_tags":"x","must_not_tags":[]}}'
          when doc_id % 7 = 2 then '[1]' else '{{"should_have_tags":[],"must_not_tags":[]}}' end as kind, lang, source, doc_id % 7 as m from documents)
      select 'tracks' as table_name, 'track_tag_selection required keys' as rule, cast(doc_id as varchar) as key from raw where m in (0, 2)
      union all select 'tracks', 'track_tag_selection is an object', cast(doc_id as varchar) from raw where m = 2
      union all select 'tracks', 'track_tag_selection.should_have_tags is an array', cast(doc_id as varchar) from raw where m in (1, 2)
      union all select 'tracks', 'track_tag_selection.must_not_tags is an array', cast(doc_id as varchar) from raw where m in (0, 2)
      union all select 'tracks', 'unique (filepath)', lang || '/' || source from raw group by lang, source having count(*) > 1"""
    # tags and contract
    q["tag_select"] = f"{TAGS1} select id, pos, category, name, {r6('score')} as score from sel"
    q["tag_lookup"] = f"{TAGS1} select id, name, {r6('score')} as score from lookup"
    q["dialogue_safe"] = f"{TAGS1} select id, {r6('t3')} as dialogue_safe_score, t3 >= {d(0.60)} as dialogue_safe from safe"
    q["tags_by_category"] = f"""{TAGS1} select id, category, string_agg(name, '|' order by pos) as names from (
        select *, row_number() over (partition by id, category order by pos) as k from sel) where k <= 2 group by id, category"""
    q["confidence_profile"] = f"{TAGS3} select id, {r6('mean')} as mean_score, {r6('hi')} as max_score, {r6('lo')} as min_score from picked"
    q["tag_vocab"] = f"{TAGS1} select category, string_agg(distinct name, '|' order by name) as names from sel group by category"
    q["tags_in_categories"] = f"{TAGS1} select distinct name from sel where category in ('emotion', 'atmosphere')"
    q["tag_prompts"] = f"""with tags(n, category, name) as (values {_TAGS})
      select cast(n as bigint) as tag_no, 'cinematic instrumental music with ' || t || '|music tagged as ' || replace(category, '_', ' ') || ': ' || t
        || '|film underscore with ' || t as prompts, n_tracks
      from (select n, category, replace(name, '_', ' ') as t, count(*) as n_tracks from embeddings, tags group by n, category, name)"""
    q["taxonomy_rows"] = """select cast(k as bigint) as tag_no, case when k < 2 then 'first' else lang end as category, case when k < 2 then source else lang end as category_pl,
        t || doc_id as name, t as name_pl from documents, (values (0, 'b'), (1, 'a'), (2, 'z'), (3, 'y'), (4, 'x')) v(k, t)"""
    q["profile_candidates"] = f"{TAGS2} select id, {joined('profiles')} as profiles from cands"
    q["track_semantics"] = f"{TAGS2} select id, {joined('emotion')} as emotional_direction, {joined('narrative')} as narrative_function, {joined('profiles')} as profiles, {r6('t3r')} as dialogue_safe_score, safe as dialogue_safe from sem"
    q["track_targets"] = f"{TAGS2} select id, energy, tempo, rhythm, shape, {joined('sound')} as sound from tgt"
    q["must_not_tags"] = f"{TAGS3} select id, {joined('must_not')} as must_not_tags from must"
    q["track_tag_selection"] = f"""{TAGS3} select p.id, {joined('p.names[1:8]')} as should_have_tags,
        {joined('list_filter(m.must_not, lambda x: not list_contains(p.names[1:8], x))')} as must_not_tags from picked p join must m using (id)"""
    q["track_texts"] = f"{TAGS3} select id, left(title, 120) as semantic_title_en, left(description, 240) as description_en, left(summary, 240) as tags_summary_en from texts2"
    some = lambda x, n, default: f"left(case when len({x}) > 0 then replace(array_to_string({x}[1:{n}], ', '), '_', ' ') else '{default}' end, 120)"
    q["track_prompts"] = f"""{TAGS3} select id, left(description, 120) as semantic_scene_prompt, left('instrumental music for ' || lower(left(title, 120)), 120) as music_for_scene_prompt,
        {some('emotion', 3, 'cinematic')} as emotion_prompt, {some('narrative', 3, 'underscore')} as narrative_prompt, {some('sound', 3, 'atmospheric')} as sonic_prompt,
        {some('names[1:8]', 6, 'cinematic')} as tag_prompt, left(summary, 120) as concise_core_prompt from texts2"""
    prompt_rows = """(select n, p, case p when 0 then 'cinematic instrumental music with ' || t
        when 1 then 'music tagged as ' || replace(category, '_', ' ') || ': ' || t else 'film underscore with ' || t end as txt
        from (select n, category, replace(name, '_', ' ') as t from tags), (values (0), (1), (2)) v(p))"""
    q["nearest_tags"] = f"""with tags(n, category, name) as (values {_TAGS}),
      tok as ({token_rows(prompt_rows, 'n, p', 'txt', 64)}),
      pv as (select n, p, bucket, cast(cast(cnt / sqrt(sum(cnt * cnt) over (partition by n, p)) as float) as double) as x from tok),
      tv0 as (select n, bucket, sum(case p when 0 then {d(.52)} when 1 then {d(.28)} else {d(.20)} end * x) as x from pv group by n, bucket),
      tv as (select n, bucket, cast(cast(x / sqrt(sum(x * x) over (partition by n)) as float) as double) as x from tv0),
      tvec as (select t.n, list(coalesce(tv.x, 0) order by b.bucket) as v
        from tags t cross join (select unnest(range(64)) as bucket) b left join tv on tv.n = t.n and tv.bucket = b.bucket group by t.n),
      ranked as (select e.vec_id as query_id, t.n as item_id, 1 - {cos('e.embedding', 't.v')} as dist,
        row_number() over (partition by e.vec_id order by round(1 - {cos('e.embedding', 't.v')}, 12), t.n) as rank from embeddings e, tvec t)
      select query_id, cast(item_id as bigint) as item_id, {r6('dist')} as distance, rank from ranked where rank <= 20"""
    # numbers
    q["audio_hints"] = f"""with x as (select event_id, value / 100 as rms, value / 500 as zcr, value * 50 as centroid,
        case when event_type <> 'error' then cast(event_id % 200 as int) end as bpm from events)
      select event_id, case when rms < {d(.03)} then 'very_low' when rms < {d(.06)} then 'low' when rms < {d(.11)} then 'medium' when rms < {d(.18)} then 'high' else 'very_high' end as energy,
        case when bpm is null then 'moderate' when bpm < 55 then 'very_slow' when bpm < 80 then 'slow' when bpm < 118 then 'moderate' when bpm < 145 then 'fast' else 'very_fast' end as tempo,
        case when bpm >= 120 then 'driving' when zcr < {d(.035)} then 'floating' when zcr < {d(.07)} then 'steady' when zcr < {d(.11)} then 'syncopated' else 'irregular' end as rhythm,
        case when rms > {d(.14)} then 'climax_peak' when zcr > {d(.09)} then 'pulsating' when rms > {d(.08)} then 'gradual_build' else 'static' end as shape,
        case when centroid < 1600 then 'intimate|analog' when centroid < 3200 then 'atmospheric|textured' else 'clean|wide' end as sound from x"""
    q["signal_stats"] = f"""with x as (select user_id, event_id, value - avg(value) over (partition by user_id) as v from events),
        y as (select *, case when (v < 0) <> (lag(v) over (partition by user_id order by event_id) < 0) then 1 else 0 end as c from x)
      select user_id as signal_id, count(*) as n_samples, {r6('sqrt(avg(v * v))')} as rms, {r6('cast(sum(c) as double) / count(*)')} as crossing_rate from y group by user_id"""
    # seconds are rounded half up in whole numbers of samples
    seconds = lambda samples: f"cast((({samples}) * 2000 + 48000) // 96000 as double) / 1000"
    start = "case when n < 960000 then 0 when i = 4 then n - 960000 else cast(floor(i * ((n - 960000) / cast(4 as double))) as bigint) end"
    q["segment_ranges"] = f"""with x as (select o_orderkey, cast(floor(o_totalprice * 20) as bigint) as n from orders),
        y as (select o_orderkey, n, i, {start} as s from x, (select unnest(range(5)) as i) where n >= 960000 or i = 0)
      select o_orderkey, i as segment_no, {seconds('s')} as start_sec, {seconds('case when n < 960000 then n else s + 960000 end')} as end_sec from y"""
    q["pitch_class"] = f"""select vec_id as id, list_extract({lit_list(K)}, list_position(v, list_max(v))) as musical_key
        from (select vec_id, list_transform(range(0, 12), lambda c: round(list_sum(list_transform(
          list_filter(range(1, len(embedding) + 1), lambda i: (i - 1) % 12 = c), lambda i: cast(embedding[i] as double))), 9)) as v from embeddings)"""
    # texts
    q["whitespace"] = f"select doc_id, {whitespace_sql('text')} as text from documents"
    q["episode_number"] = r"""with s as (select page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '^(.+)\.[^.]+$', '\1') as stem from pages)
      select page_id, case when regexp_matches(stem, '[0-9]') then cast(regexp_extract(stem, '([0-9]{1,6})', 1) as bigint) end as episode_nr from s"""
    q["scene_split"] = f"""with n as (select doc_id, {whitespace_sql('text')} as text from documents),
        p as (select doc_id, string_split(regexp_replace(text, '(?mi){HEADER}', chr(64976) || '\\0', 'g'), chr(64976))[2:] as parts from n),
        x as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from p),
        y as (select doc_id, k, {strip_sql('part')} as scene_txt from x)
      select doc_id as episode_nr, row_number() over (partition by doc_id order by k) as scene_nr, scene_txt from y where scene_txt <> ''"""
    q["embed_texts"] = f"""with tok as ({token_rows('documents', 'doc_id', 'text', 64)})
      select doc_id, cast(bucket as bigint) as bucket, {r6('cast(cnt / sqrt(sum(cnt * cnt) over (partition by doc_id)) as float)')} as value from tok"""
    # catalogs
    q["new_files"] = f"""with {TRACKS},{_existing_tracks()} select filepath, case when filepath in (select filepath from old) then 'indexed' else 'new' end as state from fx_t"""
    q["scan_stats"] = f"""with {TRACKS},{_existing_tracks()} select (select count(*) from old) as total_saved_in_track_query,
      count(*) filter (where filepath in (select filepath from old)) as already_saved_in_current_scan,
      count(*) filter (where filepath not in (select filepath from old)) as new_in_current_scan from fx_t"""
    status = "case when event_type = 'error' then 'error' when event_type = 'click' then 'inserted' when event_type = 'view' then 'updated' else 'skipped' end"
    q["ingest_report"] = f"""with o as (select lpad(cast(event_id as varchar), 9, '0') as filepath, {status} as status from events)
      select count(*) filter (where status = 'inserted') as inserted, count(*) filter (where status = 'updated') as updated,
        count(*) filter (where status = 'skipped') as skipped, count(*) filter (where status = 'error') as failed,
        count(*) filter (where status <> 'skipped') as total_attempted,
        {r6("cast(count(*) filter (where status in ('inserted', 'updated')) as double) / greatest(1, count(*) filter (where status <> 'skipped'))")} as success_rate,
        (select string_agg(filepath || ' :: IOError :: bad file', '|' order by filepath) from (select filepath from o where status = 'error' order by filepath limit 50)) as errors from o"""
    q["audio_names"] = """select url as path from (select page_id, url || case page_id % 4 when 0 then '/a.MP3' when 1 then '/._b.wav' when 2 then '/c.flac' else '/d.txt' end as url from pages)
      where regexp_matches(lower(url), '\\.(wav|mp3|flac|ogg|m4a)$') and not regexp_matches(url, '/\\._[^/]*$')"""
    q["import_run"] = f"""with {TRACKS},{_existing_tracks()}, t as (select *, id - {TRACK_BASE} as v from fx_t),
        o as (select *, case when filepath in (select filepath from old) then 'skipped' when v % 10 = 9 then 'IOError' when v % 17 = 3 then 'NoSegments'
            when v % 19 = 4 then 'UnevenSegments' when v % 37 = 8 then 'NoDirection' when v % 23 = 5 then 'EmptyText' when v % 29 = 7 then 'NoVector'
            when v % 31 = 11 then 'ValueError' else 'inserted' end as s,
          array_to_string(list_filter([case when v % 23 = 5 then 'main_text: main_text is empty' end,
            case when v % 29 = 7 then 'tags_text: ' || {wordless} end,
            case when v % 31 = 11 then 'emotion_prompt: cannot read boom ' || v end], lambda x: x is not null), '; ') as texts from t)
      select filepath, case when s in ('skipped', 'inserted') then s else 'error' end as status, case when s not in ('skipped', 'inserted') then s end as error_type,
        case s when 'skipped' then null when 'inserted' then null when 'IOError' then 'bad file' when 'NoSegments' then 'no segment vectors'
          when 'UnevenSegments' then 'segment vectors of unequal length' when 'NoDirection' then 'the mean of the segment vectors is zero' else texts end as error,
        case s when 'skipped' then old_title when 'inserted' then 'Cue ' || v end as title
      from o left join (select filepath, semantic_title_en as old_title from old) using (filepath)"""
    q["upsert_tracks"] = f"""with {TRACKS},{_existing_tracks()} select coalesce(o.id, t.id) as id, coalesce(t.filename, o.filename) as filename, filepath,
      {r6('coalesce(t.duration_sec, o.duration_sec)')} as duration_sec, coalesce(t.semantic_title_en, o.semantic_title_en) as semantic_title_en,
      case when t.id is null then 'kept' when o.id is null then 'inserted' else 'updated' end as merge_action
      from old o full outer join (select id, filename, filepath, duration_sec, semantic_title_en from fx_t) t using (filepath)"""
    q["upsert_published"] = f"""with {TRACKS},{_existing_tracks()} select coalesce(o.id, t.id) as id, coalesce(t.filename, o.filename) as filename, filepath,
      {r6('coalesce(t.duration_sec, o.duration_sec)')} as duration_sec, coalesce(t.semantic_title_en, o.semantic_title_en) as semantic_title_en, t.id is not null as stamped
      from old o full outer join (select id, filename, filepath, duration_sec, semantic_title_en from fx_t) t using (filepath)"""
    q["upsert_scenes"] = f"""with {SCENES}, o as (select doc_id + 9000 as id, doc_id // 40 + 1 as episode_nr, (doc_id % 40) // 2 + 1 as scene_nr, doc_id % 2 + 1 as theme_nr, 'Old ' || doc_id as theme_title_en from documents)
      select coalesce(o.id, s.id) as id, {PLACE}, coalesce(s.theme_title_en, o.theme_title_en) as theme_title_en,
      case when s.id is null then 'kept' when o.id is null then 'inserted' else 'updated' end as merge_action
      from o full outer join (select id, {PLACE}, theme_title_en from fx_s) s using ({PLACE})"""
    match_old = f"""om as (select doc_id // 40 + 1 as episode_nr, doc_id as scene_query_id, (doc_id * 7) % 500 + {TRACK_BASE} as track_query_id, cast(n_chars as double) as final_score from documents),
      nm as (select vec_id // 20 + 1 as episode_nr, vec_id as scene_query_id, (vec_id * 7) % 500 + {TRACK_BASE} as track_query_id, cast(label as double) as final_score from embeddings)"""
    q["replace_episode"] = f"""with {match_old} select * from om where episode_nr <> 3 union all select * from nm where episode_nr = 3"""
    q["rerun_episode"] = f"""with {match_old} select * from om where episode_nr <> 2 union all select * from nm where episode_nr = 2"""
    q["replace_empty"] = f"""with {match_old} select * from om where episode_nr not in (2, 4) union all select * from nm where episode_nr = 2"""
    q["replace_episodes"] = f"""with {match_old} select * from om where episode_nr not in (select episode_nr from nm) union all select * from nm"""
    q["merge_matches"] = f"""with {match_old} select coalesce(n.episode_nr, o.episode_nr) as episode_nr, scene_query_id, track_query_id, coalesce(n.final_score, o.final_score) as final_score,
      case when n.final_score is null then 'kept' when o.final_score is null then 'inserted' else 'updated' end as merge_action
      from om o full outer join nm n using (scene_query_id, track_query_id)"""
    q["replace_scene"] = f"""with {match_old} select * from om where scene_query_id <> 17 union all select * from nm where scene_query_id = 17"""
    q["delete_episode"] = f"""with {match_old} select * from om where episode_nr <> 2"""
    q["cascade_delete"] = f"""with {match_old} select * from om where scene_query_id in (select vec_id from embeddings where vec_id // 20 + 1 <> 2) and track_query_id in (select vec_id + {TRACK_BASE} from embeddings)"""
    # scene answers and reports
    q["answer_validation"] = """select doc_id as scene_nr, array_to_string(list_filter([
        case when lang = 'fr' then 'themes[0].theme_title_en is empty' end], lambda x: x is not null), '|') as issues from documents"""
    summary = "substr(coalesce(text, ''), 1, case when n_chars % 5 = 0 then 140 else 100 end)"
    q["query_validation"] = f"""select doc_id as scene_nr, array_to_string(list_filter([
        case when {strip_sql(summary)} = '' then 'tags_summary_en is empty' end,
        case when length({summary}) > 120 then 'tags_summary_en is longer than 120' end,
        case when lang = 'en' then 'weight_profile is empty' end,
        case when n_chars % 3 = 0 then 'overlapping tags: calm' end,
        case when doc_id % 7 = 3 then 'energy_target is not a text' end,
        case when doc_id % 11 = 5 then 'sound_character_target is not a list of texts' end], lambda x: x is not null), '|') as issues from documents"""
    q["assemble_records"] = """select doc_id + 1 as scene_nr, cast(k as bigint) as theme_nr, 'why' as segmentation_reason, 'T' || doc_id || '-' || k as theme_title_en,
        'sum ' || doc_id as tags_summary_en from documents, (select unnest([1, 2]) as k)"""
    scene_parts = f"""n as (select doc_id, {whitespace_sql('text')} as text from documents),
        p as (select doc_id, string_split(regexp_replace(text, '(?mi){HEADER}', chr(64976) || '\\0', 'g'), chr(64976))[2:] as parts from n where doc_id % 17 <> 9),
        x as (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as k from p),
        y as (select doc_id, k, {strip_sql('part')} as scene_txt from x),
        sc as (select doc_id as e, row_number() over (partition by doc_id order by k) as n, scene_txt from y where scene_txt <> '')"""
    q["scene_rejects"] = f"""with {scene_parts}
      select 'doc_x.txt' as file_name, cast(null as bigint) as episode_nr, 'no episode number in the file name' as reason from documents where doc_id % 17 = 9
      union all select 'doc_' || doc_id || '.txt', doc_id, case when coalesce(text, '') = '' then 'empty text' else 'no scene headers found, expected keyword "' || '{HEADER}' || '"' end
        from n where doc_id % 17 <> 9 and doc_id not in (select e from sc)"""
    q["scene_import"] = f"""with {SCENES}, {match_old}, {scene_parts},
        lists as (select * from sc where n % 7 <> 3 and e % 11 <> 5), twice as (select * from sc where e % 5 <> 2 and e % 29 = 3 and n = 2),
        asked as (select * from sc where e % 5 <> 2 and not (e % 29 = 3 and n = 2)),
        made as (select l.* from lists l join asked using (e, n) where e > 0),
        r(e, n, k, stage, reason) as (
          select null, null, null, 'text', 'no episode number in the file name' from documents where doc_id % 17 = 9
          union all select doc_id, null, null, 'text', case when coalesce(text, '') = '' then 'empty text' else 'no scene headers found, expected keyword "' || '{HEADER}' || '"' end
            from n where doc_id % 17 <> 9 and doc_id not in (select e from sc)
          union all select e, 100000, null, 'answers', 'theme list without a scene' from sc where n = 1
          union all select e, n, null, 'answers', 'scene without a theme list' from sc where n % 7 = 3
          union all select e, n, null, 'answers', 'themes[0].theme_title_en is empty' from sc where n % 7 <> 3 and e % 11 = 5
          union all select e, n, 1, 'answers', 'several answers for one theme query' from twice, (values (1), (2))
          union all select e, n, null, 'answers', 'numbers must be positive' from lists where e = 0
          union all select e, n, 1, 'answers', 'theme without a valid query' from lists l where e > 0 and not exists (from asked a where a.e = l.e and a.n = l.n)
          union all select e, n, 1, 'answers', 'query without a theme' from asked a where not exists (from lists l where l.e = a.e and l.n = a.n and l.e > 0)
          union all select e, n, 1, 'vectors', 'tags_text: ' || {wordless} from made where e % 13 = 6)
      select 'scene' as kind, e as episode_nr, n as scene_nr, cast(1 as bigint) as theme_nr, 'T' || e as theme_title_en, cast(length(scene_txt) as bigint) as n, cast(null as varchar) as note
        from made where e % 13 <> 6
      union all select 'scene', {PLACE}, theme_title_en, length('Text ' || id), null from fx_s where episode_nr not in (select e from sc)
      union all select 'reject', e, n, k, stage, null, reason from r
      union all select 'match', episode_nr, scene_query_id, null, null, track_query_id, null from om where episode_nr not in (select e from sc)"""
    q["assembly_rejects"] = """with k as (select doc_id, doc_id % 6 as m, doc_id % 5 = 2 and k = 2 as no_query, k from documents, (select unnest([1, 2]) as k))
      select -(doc_id + 1) as scene_nr, cast(null as bigint) as theme_nr, 'numbers must be positive' as reason from documents where doc_id % 6 = 5
      union all select doc_id + 1, cast(k as bigint), 'theme without a valid query' from k where m < 4 and no_query
      union all select doc_id + 1, cast(k as bigint), 'query without a theme' from k where m >= 4 and not no_query"""
    category_of = {
        "emotional_direction": ("emotion", "emotion"), "narrative_function": ("narrative", "narrative"),
        "weight_profile": ("[profile]", "scene"), "energy_target": ("[energy]", "energy"), "tempo_target": ("[tempo]", "tempo"),
        "rhythm_target": ("[rhythm]", "rhythm"), "intensity_shape_target": ("[shape]", "intensity_shape"),
        "sound_character_target": ("sound", "sound_character"), "should_have_tags": ("should", None), "must_not_tags": ("must_not", None),
    }
    allowed_of = {
        c: [fv.ANSWER_NARRATIVE_SWAP.get(w, w) if c == "narrative" else w for w in data["tags"]] for c, data in fv.TAXONOMY.items()
    }
    allowed_of[None] = sorted({w for listed in allowed_of.values() for w in listed})
    rows = [
        f"select id, '{field}' as field, unnest(list_filter(list_distinct({column}), lambda x: not list_contains({lit_list(allowed_of[category])}, x))) as word from fx_s"
        for field, (column, category) in category_of.items()
    ]
    q["vocab_check"] = f"with {SCENES} " + " union all ".join(rows)
    prompts_text = " || chr(10) || ".join(f"'{p}: {p} ' || id" for p in PROMPTS)
    q["field_lines"] = f"""with {SCENES}
      select id, cast(1 as bigint) as field_no, 'episode_nr' as field, cast(episode_nr as varchar) as value from fx_s union all
      select id, 2, 'scene_nr', cast(scene_nr as varchar) from fx_s union all select id, 3, 'theme_nr', cast(theme_nr as varchar) from fx_s union all
      select id, 4, 'segmentation_reason', segmentation_reason from fx_s union all select id, 5, 'theme_title_pl', theme_title_pl from fx_s union all
      select id, 6, 'theme_title_en', theme_title_en from fx_s union all select id, 7, 'description_en', description_en from fx_s union all
      select id, 8, 'theme_txt', theme_txt from fx_s union all select id, 9, 'tags_summary_en', tags_summary_en from fx_s union all
      select id, 10, 'scene_music_semantics', 'emotional_direction: ' || array_to_string(emotion, ', ') || chr(10) || 'narrative_function: ' || array_to_string(narrative, ', ')
        || chr(10) || 'weight_profile: ' || profile || chr(10) || 'dialogue_safe_required: ' || case when dialogue then 'True' else 'False' end from fx_s union all
      select id, 11, 'scene_music_targets', 'energy_target: ' || energy || chr(10) || 'tempo_target: ' || tempo || chr(10) || 'rhythm_target: ' || rhythm || chr(10)
        || 'intensity_shape_target: ' || shape || chr(10) || 'sound_character_target: ' || array_to_string(sound, ', ') from fx_s union all
      select id, 12, 'scene_tag_selection', 'should_have_tags: ' || array_to_string(should, ', ') || chr(10) || 'must_not_tags: ' || array_to_string(must_not, ', ') from fx_s union all
      select id, 13, 'clap_prompt_ensemble', {prompts_text} from fx_s"""
    q["round_floats"] = f"select event_id, {half_up3('value / 7')} as direct, {half_up3('value / 11')} as nested from events"
    q["json_decode"] = """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events"""
    return q
