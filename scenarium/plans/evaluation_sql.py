"""SQL (DuckDB's dialect) of the queries in ``evaluation``, written apart from their plans."""

from __future__ import annotations

from scenarium import dims


def _map(table: dict) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    return "map {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def _list(items: list[str]) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + ")"


def _get(table: dict, key: str) -> str:
    return f"map_extract({_map(table)}, {key})[1]"


def folded(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"replace(lower(trim({x})), '_', ' ')"


def singular(x: str) -> str:
    """Of a phrase of folded words."""
    w = (
        f"coalesce({_get(dims.IRREGULAR_SINGULARS, 'w')}, case when w in {_list(dims.INVARIANT_NOUNS)} or len(w) <= 3 or not w like '%s' or regexp_matches(w, '(ss|us)$') then w "
        "when regexp_matches(w, '(sses|xes|ches|shes)$') then left(w, len(w) - 2) when w like '%ies' then left(w, len(w) - 3) || 'y' else left(w, len(w) - 1) end)"
    )
    return f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> ''), lambda w: {w}), ' ')"


_TOKENS = "regexp_extract_all(replace(lower({0}), 'n''t', ' n''t '), '[0-9]+(?:[.,:][0-9]+)*|n''t\\b|''(?:s|re|ve|ll|d|m)\\b|[\\p{{L}}\\p{{N}}]+(?:-[\\p{{L}}\\p{{N}}]+)*')"


def _cider(words: str) -> str:
    """The scorer's formula for each candidate, reference and n; a group is a condition, a document the references of one candidate."""
    return f"""with rows as (select pred_id, any_value(image_id) as image_id, coalesce(any_value(detector), '') as detector, coalesce(any_value(scene_model), '') as scene_model, any_value(captioner) as captioner, any_value(caption) as caption from core_preds group by pred_id),
cands as (select *, {words.format('caption')} as w from rows where caption is not null and image_id is not null and captioner is not null),
refs as (select image_id, captioner as ref, arg_min(w, pred_id) as w from cands group by all),
pairs as (select c.pred_id, c.detector, c.scene_model, c.captioner, r.ref, c.w as cw, r.w as rw from cands c join refs r on r.image_id = c.image_id and r.ref <> c.captioner),
ns as (select unnest([1, 2, 3, 4]) as n),
cg as (select pred_id, n, array_to_string(w[i:i + n - 1], ' ') as gram, count(*) as tf from (select distinct pred_id, cw as w from pairs), ns, range(1, 300) t(i) where i <= len(w) - n + 1 group by all),
rg as (select detector, scene_model, captioner, pred_id, ref, n, array_to_string(rw[i:i + n - 1], ' ') as gram, count(*) as tf from pairs, ns, range(1, 300) t(i) where i <= len(rw) - n + 1 group by all),
docs as (select detector, scene_model, captioner, ln(count(distinct pred_id)) as total from pairs group by all),
df as (select detector, scene_model, captioner, n, gram, count(distinct pred_id) as df from rg group by all),
rv as (select pred_id, ref, n, gram, tf * (total - ln(df)) as x from rg join df using (detector, scene_model, captioner, n, gram) join docs using (detector, scene_model, captioner)),
cv as (select g.pred_id, g.n, g.gram, tf * (total - ln(coalesce(df, 1))) as x from cg g join cands c using (pred_id) join docs d using (detector, scene_model, captioner)
  left join df on df.detector = c.detector and df.scene_model = c.scene_model and df.captioner = c.captioner and df.n = g.n and df.gram = g.gram),
rl as (select pred_id, ref, n, sqrt(sum(x * x)) as l from rv group by all), cl as (select pred_id, n, sqrt(sum(x * x)) as l from cv group by all),
d as (select r.pred_id, ref, n, sum(least(c.x, r.x) * r.x) as d from rv r join cv c using (pred_id, n, gram) group by all),
scored as (select p.pred_id, p.ref, ns.n, coalesce(case when rl.l * cl.l > 0 then d.d / (rl.l * cl.l) end, 0) * exp(-((greatest(len(cw) - 1, 0) - greatest(len(rw) - 1, 0)) ** 2) / 72.0) / 4 as s
  from pairs p, ns left join d on d.pred_id = p.pred_id and d.ref = p.ref and d.n = ns.n left join rl on rl.pred_id = p.pred_id and rl.ref = p.ref and rl.n = ns.n left join cl on cl.pred_id = p.pred_id and cl.n = ns.n)
"""


def build(aliases: dict, rules: list, stop_words: list[str], scenes: dict, width: float, height: float) -> dict[str, str]:
    """The queries' SQL for the given parameters."""
    canon = lambda x: f"coalesce({_get(aliases, folded(x))}, {folded(x)})"
    cat = lambda x: f"coalesce({_get(dims.CATEGORY_OF, x)}, 'object')"
    by_cat = {label: dims.CATEGORY_FAMILY[c] for label, c in dims.CATEGORY_OF.items()}
    family = lambda x, t=dims.SOUND_FAMILY_OF: f"coalesce({_get(t, x)}, {_get(by_cat, x)})"
    fam_w = lambda x: f"coalesce({_get(dims.FAMILY_WEIGHTS, x)}, {dims.NO_FAMILY_WEIGHT})"
    label_w = lambda x: f"coalesce({_get(dims.LABEL_WEIGHT_OF, x)}, {fam_w(family(x))})"
    once = lambda t, keys, cols="*": f"(select distinct on ({keys}) {cols} from {t})"
    preds = once("core_preds", "pred_id")
    sets = f"""
refs as (select image_id, list_sort(list(distinct {canon('label')})) as ref from entities where image_id is not null and {folded('label')} <> '' group by image_id),
preds as (
  select p.*, list_sort(list_distinct(list_filter(list_transform(coalesce(visual_terms, []), lambda t: {canon('t')}), lambda t: t is not null and t <> ''))) as pred, coalesce(r.ref, []) as ref
  from {preds} p left join refs r using (image_id)
)
"""
    prf = lambda p, r, n="": f"""
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else len(list_intersect({p}, {r}))::double / len({p}) end, 6)::double as {n}precision,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else len(list_intersect({p}, {r}))::double / len({r}) end, 6)::double as {n}recall,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else 2.0 * len(list_intersect({p}, {r})) / (len({p}) + len({r})) end, 6)::double as {n}f1"""  # noqa: E731
    wprf = lambda p, r, w, n: f"""
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else {w(f'list_intersect({p}, {r})')} / {w(p)} end, 6)::double as {n}precision,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else {w(f'list_intersect({p}, {r})')} / {w(r)} end, 6)::double as {n}recall,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else 2 * {w(f'list_intersect({p}, {r})')} / ({w(p)} + {w(r)}) end, 6)::double as {n}f1"""  # noqa: E731
    weigh = lambda each: lambda items: f"coalesce(list_sum(list_transform({items}, lambda x: {each('x')}))::double, 0)"
    boxes = f"""
boxes as (
  select pred_id, row_id, ord, visual_label_raw as label, coalesce(detector_confidence, 0.0) as confidence, bbox[1] as x1, bbox[2] as y1, bbox[3] as x2, bbox[4] as y2
  from {once('groundings', 'row_id')} where len(bbox) = 4 and pred_id is not null and visual_label_raw is not null
)
"""
    area = lambda p: f"(greatest(0, {p}x2 - {p}x1) * greatest(0, {p}y2 - {p}y1))"
    inter = lambda a, b: f"(greatest(0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * greatest(0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))"
    iou = lambda a, b: f"(case when {area(a)} + {area(b)} - {inter(a, b)} <= 0 then 0.0 else {inter(a, b)} / ({area(a)} + {area(b)} - {inter(a, b)}) end)"
    inside = lambda a, b: f"(case when {area(a)} <= 0 then 0.0 else {inter(a, b)} / {area(a)} end)"
    geo = lambda src: f"""
geo as (
  select *, least(greatest(0, x2 - x1) * greatest(0, y2 - y1) / {width * height}, 1.0) as ratio,
    (case when (x1 + x2) / 2 < {width / 3!r} then 'left' when (x1 + x2) / 2 < {2 * width / 3!r} then 'center' else 'right' end) || '-' ||
    (case when (y1 + y2) / 2 < {height / 3!r} then 'top' when (y1 + y2) / 2 < {2 * height / 3!r} then 'middle' else 'bottom' end) as place
  from (select * exclude (x1, y1, x2, y2, label), {norm('label')} as label, least(a1, a2) as x1, least(b1, b2) as y1, greatest(a1, a2) as x2, greatest(b1, b2) as y2 from (
    select *, greatest(0, least(x1, {width})) as a1, greatest(0, least(x2, {width})) as a2, greatest(0, least(y1, {height})) as b1, greatest(0, least(y2, {height})) as b2 from {src}))
),
geo2 as (
  select *, case when ratio < 0.01 then 'tiny' when ratio < 0.05 then 'small' when ratio < 0.15 then 'medium' when ratio < 0.35 then 'large' else 'dominant' end as size,
    least(0.65::double * confidence + 0.35::double * least(greatest(0, x2 - x1) * greatest(0, y2 - y1) / {width * height} / 0.35, 1.0) + case when place = 'center-middle' then 0.15::double else 0.0::double end, 1.0) as sal from geo
)
"""  # noqa: E731
    good = "confidence between 0 and 1 and not isnan(confidence)"
    dets = f"(select * from {once('detections', 'det_id')} where {good})"

    def greedy(conflict: str) -> str:
        # Each prediction's boxes in order; a box is kept if no kept one before it conflicts.
        return f"""with recursive {boxes},
ranked as (select *, row_number() over (partition by pred_id order by confidence desc, ord, row_id) as rnk, {norm('label')} as lab from boxes),
walk(pred_id, rnk, kept) as (
  select pred_id, 0::bigint, []::bigint[] from (select distinct pred_id from ranked)
  union all
  select w.pred_id, r.rnk, case when exists (select 1 from ranked k where k.pred_id = w.pred_id and list_contains(w.kept, k.row_id) and {conflict}) then w.kept else list_append(w.kept, r.row_id) end
  from walk w join ranked r on r.pred_id = w.pred_id and r.rnk = w.rnk + 1
),
done as (select distinct on (pred_id) pred_id, kept from walk order by pred_id, rnk desc)
select unnest(kept) as row_id from done
"""

    groups = {w: g for w, g in dims.ALIAS_GROUP_OF.items()}
    alias_conflict = (
        f"{_get(groups, 'k.lab')} = {_get(groups, 'r.lab')} and case when {_get(groups, 'r.lab')} = 'human' then {iou('r.', 'k.')} >= 0.75 "
        f"else {iou('r.', 'k.')} >= 0.30 or {inside('r.', 'k.')} >= 0.65 or {inside('k.', 'r.')} >= 0.65 end"
    )
    terms = f"terms as (select distinct pred_id, {norm('t')} as term from core_preds, unnest(visual_terms) as u(t) where trim({norm('t')}) <> '')"
    rule_rows = "rules(rule_id, name, evidence) as (values " + ", ".join(f"('{i}', '{n}', '{e}')" for i, n, e in rules) + ")"
    rule_terms = f"""{rule_rows},
rgroups as (select rule_id, name, unnest(g) as grp, unnest(range(len(g))) as group_no, len(g) as n_groups from (select *, string_split(evidence, ' and ') as g from rules)),
rterms as (select rule_id, name, group_no, n_groups, unnest(string_split(grp, ' or ')) as term from rgroups)"""
    base = "(select * from onto_nodes where ontology_id = 'base')"
    onto = lambda src: f"""
ids as (select distinct id from {src} where id is not null),
edges as (select distinct n.id as p, u.c as c from {src} n, unnest(n.child_ids) as u(c) where n.id is not null and u.c in (select id from ids)),
roots as (select id from ids where id not in (select c from edges))
"""  # noqa: E731
    usable = "usable as (select id, min(name) as name from onto_nodes where id is not null group by id having not list_has_any(flatten(list(coalesce(restrictions, []))), ['blacklist', 'abstract']))"
    node_sets = """
rows_ as (select p.image_id, p.captioner, n.audioset_id as item from (select distinct on (pred_id) pred_id, image_id, captioner from core_preds) p join core_nodes n using (pred_id)
  where p.image_id is not null and n.audioset_id is not null),
pn as (select distinct image_id, item from rows_ where captioner = 'cap_alder'), rn as (select distinct image_id, item from rows_ where captioner = 'cap_cedar')
"""
    seg = "array_to_string(list_transform(regexp_split_to_array({0}, '[,.;:!?()]'), lambda s: " + folded("s") + "), ' | ')"
    scene_name = singular(folded("replace(string_split(coalesce(scene.label, ''), '/')[1], '_', ' ')"))
    search = (
        f"(select pred_id, s, case when name = '' then s2 else regexp_replace(s2, '\\b' || name || '\\b', ' | ', 'g') end as searched from "
        f"(select pred_id, s, {singular('s')} as s2, name from (select pred_id, {seg.format('caption')} as s, {scene_name} as name from {preds} where caption is not null)))"
    )
    words = lambda x: f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
    lower_io = norm("scene.label")
    group = _get(scenes, lower_io)
    expected = [f"{g}|{f}" for g, fs in dims.SCENE_EXPECTED.items() for f in fs]
    fam_rows = lambda col, t=dims.SOUND_FAMILY_OF: f"(select pred_id, fam, count(*) as n from (select pred_id, {family('l', t)} as fam from preds, unnest({col}) as u(l)) where fam is not null group by all)"
    join_list = "case when len({0}) = 0 then '' when len({0}) = 1 then {0}[1] when len({0}) = 2 then {0}[1] || ' and ' || {0}[2] else array_to_string({0}[1:len({0}) - 1], ', ') || '{1}' || {0}[len({0})] end"
    phrase = "case when coalesce(scene.indoor_outdoor, '') not in ('', 'unknown') then 'an ' || scene.indoor_outdoor || ' ' else 'a ' end || replace(trim(scene.label), '_', ' ') || ' scene'"
    emb = lambda x: f"trim(regexp_replace(translate(lower(trim({x})), '_-/', '   '), '\\s+', ' ', 'g'))"
    bodies = """cleaned as (select distinct on (nested_id) nested_id, ltrim(body, chr(65279) || ' ' || chr(10)) as b from nested_preds),
opened as (select nested_id, case when b[1] = '"' and json_valid(b) then b::json->>'$' else b end as b from cleaned),
bodies as (select nested_id, b::json as j from opened where json_valid(b) and json_type(b) = 'OBJECT')"""
    arr = lambda p: f"(case when json_type(j, '{p}') = 'ARRAY' then json_extract(j, '{p}[*]') else [] end)"
    txt = lambda x, k: f"list_distinct(list_filter(list_transform({x}, lambda e: e->>'$.{k}'), lambda t: t is not null))"
    ngram = lambda n, src, keys: f"select {keys}, {n} as n, gram, count(*)::double as tf from (select {keys}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) as gram from {src} where len(w) >= {n}) group by all"
    loose = f"(select pred_id, {words(folded('caption'))} as w, ref from preds where caption is not null)"
    sql = {
        "text_forms": f"""select distinct label, {folded('label')} as folded, translate(lower(trim(label)), '_/', '  ') as scene, {norm('label')} as normalised,
  coalesce(nullif({norm('label')}, ''), 'unknown') as or_unknown, {emb('label')} as embedding, {canon('label')} as canonical, {singular(folded('label'))} as singular from detections""",
        "confidence_unit": f"select det_id, round(case when isnan(coalesce(confidence, 0.5)) then 0.0 else greatest(0, least(1, coalesce(confidence, 0.5))) end, 6) as confidence from {once('detections', 'det_id')}",
        "caption_segments": f"select pred_id, s as segments, searched from {search}",
        "english_lists": f"select pred_id, {join_list.format('t', ', and ')} as oxford, {join_list.format('t', ' and ')} as plain from (select pred_id, list_filter(visual_terms, lambda x: x is not null) as t from {preds} where visual_terms is not null)",
        "count_bins": f"select case when n <= 0 then 'none' when n = 1 then 'single' when n <= 3 then 'few' when n <= 10 then 'group' else 'dense' end as bin, count(*) as n from (select coalesce(count_estimate, 0) as n from {once('entities', 'pred_id, id')}) group by 1",
        "path_conditions": f"""select file_id, case when f like 'grounding_dino_%' then 'grounding_dino' when f like 'owlv2_%' then 'owlv2' else 'unknown' end as detector,
  case when f like 'grounding_dino_%' then replace(f, 'grounding_dino_', '') when f like 'owlv2_%' then replace(f, 'owlv2_', '') when f in ('json', 'legacy') then coalesce(g, '') else 'unknown' end as scene_model,
  case when json_path like '%captions_gemma%' then 'gemma' else 'template' end as captioner
  from (select file_id, json_path, coalesce(string_split(json_path, '/')[-2], '') as f, string_split(json_path, '/')[-3] as g from {once('pred_files', 'file_id')} where json_path is not null)""",
        "schema_counts": f"with {bodies} select case when json_exists(j, '$.core.nodes') then 'audioset' else 'legacy' end as kind, count(*) as n from bodies group by 1",
        "box_geometry": f"with {geo(dets)} select det_id, label, x1::double as x1, y1::double as y1, x2::double as x2, y2::double as y2, (floor(ratio * 1000000.0 + 0.5) / 1000000.0)::double as area_ratio, size as relative_size, place as position_coarse, place = 'center-middle' as is_central, (floor(sal * 1000000.0 + 0.5) / 1000000.0)::double as salience from geo2",
        "box_overlaps": f"""with {boxes}, n as (select *, lead(struct_pack(row_id, x1, y1, x2, y2)) over (partition by pred_id order by ord, row_id) as k from boxes)
select row_id, k.row_id as next_id, round({iou('n.', 'k.')}, 6)::double as iou, round({inside('n.', 'k.')}, 6)::double as inside from n where k is not null""",
        "category_coverage": f"""with {boxes}, {geo('boxes')}, per as (select pred_id, {cat('label')} as category, count(*) as n, sum(ratio) as part from geo2 group by all)
select pred_id, category, n, (floor(part * 1000000.0 + 0.3) / 1000000.0)::double as part, (floor(least(sum(part) over (partition by pred_id), 1.0) * 1000000.0 + 0.3) / 1000000.0)::double as total, (floor(least(sum(n) over (partition by pred_id) / 20.0, 1.0) * 1000000.0 + 0.5) / 1000000.0)::double as density from per""",
        "nms_kept": greedy(f"{iou('r.', 'k.')} >= 0.3"),
        "alias_kept": greedy(alias_conflict),
        "detection_differences": f"""with d as (select image_id, source, count(*) as r, count(*) filter (confidence >= 0.5 and not isnan(confidence)) as f from {once('detections', 'det_id')} where image_id is not null group by all)
select a.image_id, a.r as n_raw_before, b.r as n_raw_after, a.f as n_filtered_before, b.f as n_filtered_after, b.f - a.f as filtered_delta from d a join d b using (image_id) where a.source = 'det_flint' and b.source = 'det_quartz'""",
        "rule_terms": f"with {rule_terms} select rule_id, group_no, term from rterms",
        "rules_fired": f"with {terms}, {rule_terms} select pred_id, rule_id from terms join rterms using (term) group by pred_id, rule_id, n_groups having count(distinct group_no) = n_groups",
        "rule_nodes": f"""with {rule_terms}, hits as (select image_id, confidence, r.* from {dets} d join rterms r on r.term = {norm('d.label')} where image_id is not null),
g as (select image_id, rule_id, name, n_groups, group_no, max(confidence) as best, count(*) as n, list(distinct term) as t from hits group by all),
r as (select image_id, rule_id, name, n_groups, min(best) as confidence, sum(n)::bigint as n_grounding, list_sort(list_distinct(flatten(list(t)))) as t from g group by all having count(*) = n_groups)
select image_id, 'n' || row_number() over (partition by image_id order by name, rule_id) as node_id, rule_id, name, confidence, array_to_string(t, '|') as terms, n_grounding, case when n_groups = 1 then n_grounding end as instance_count from r""",
        "prompt_batches": f"""with {terms}, d as (select distinct term from terms), n as (select term, (row_number() over (order by term) - 1) // 30 + 1 as b from d)
select 'audioset_leaf_terms:' || lpad(b::varchar, 2, '0') as batch, count(*) as n_terms, string_agg(term, ', ' order by term) as prompt from n group by b""",
        "ontology_names": f"""with u as (select id, min(name) as name from {base} where id is not null group by id having not list_has_any(flatten(list(coalesce(restrictions, []))), ['blacklist', 'abstract'])),
k as (select lower(trim(name)) as name, 0 as r, id from u where name is not null union all select lower(trim(p)), 1, id from u, unnest(string_split(name, ',')) as t(p) where name is not null)
select name, arg_min(id, (r, id)) as id from k where name <> '' group by name""",
        "ontology_integrity": f"""with recursive {onto('onto_nodes')}, reach(a, b) as (select p, c from edges union select r.a, e.c from reach r join edges e on r.b = e.p)
select (select count(*) from ids) as n_nodes, (select count(*) from roots) as n_roots, (select count(*) from (select c from edges group by c having count(*) > 1)) as n_multi_parent,
  (select count(*) from (select distinct n.id, u.c from onto_nodes n, unnest(n.child_ids) as u(c) where u.c is not null and n.id is not null and u.c not in (select id from ids))) as n_dangling,
  (select count(distinct a) from reach where a = b) as n_cyclic""",
        "ontology_parents": f"with {onto('onto_nodes')} select ids.id as node, coalesce(e.p, ids.id) as parent from ids left join edges e on e.c = ids.id",
        "ontology_leaves": f"with {onto('onto_nodes')}, {usable} select id from usable where id not in (select p from edges)",
        "ontology_distances": f"""with recursive {onto(base)}, w(node, anc, d) as (select id, id, 0::bigint from ids union select e.c, w.anc, w.d + 1 from w join edges e on e.p = w.node where w.d < 60)
select node, anc, min(d) as near from w group by all""",
        "hierarchical_prf": f"""with recursive {onto('onto_nodes')}, {node_sets},
reach(a, b) as (select p, c from edges union select r.a, e.c from reach r join edges e on r.b = e.p),
tops as (select b as item, a as too from reach where a in (select id from roots) union select id, id from roots),
ups as (select ids.id as item, coalesce(e.p, ids.id) as too from ids left join edges e on e.c = ids.id),
img as (select distinct image_id from pn where image_id in (select image_id from rn)),
s as (select image_id, (select list(distinct item) from pn where pn.image_id = img.image_id) as p0, (select list(distinct item) from rn where rn.image_id = img.image_id) as r0,
  (select list(distinct too) from pn join ups using (item) where pn.image_id = img.image_id) as p1, (select list(distinct too) from rn join ups using (item) where rn.image_id = img.image_id) as r1,
  (select list(distinct too) from pn join tops using (item) where pn.image_id = img.image_id) as p2, (select list(distinct too) from rn join tops using (item) where rn.image_id = img.image_id) as r2 from img),
c as (select image_id, coalesce(p0, []) as p0, coalesce(r0, []) as r0, coalesce(p1, []) as p1, coalesce(r1, []) as r1, coalesce(p2, []) as p2, coalesce(r2, []) as r2 from s)
select image_id, {prf('p0', 'r0', 'node_')}, {prf('p1', 'r1', 'parent_')}, {prf('p2', 'r2', 'top_')} from c""",
        "best_similarity": f"""with recursive {onto(base)}, {node_sets},
w(node, anc, d) as (select id, id, 0::bigint from ids union select e.c, w.anc, w.d + 1 from w join edges e on e.p = w.node where w.d < 60),
reach as (select node, anc, min(d) as near from w group by all),
loops as (select distinct e.p as id from edges e join reach r on r.node = e.p and r.anc = e.c),
ways(node, d) as (select id, 0::bigint from roots where id not in (select id from loops) union select e.c, v.d + 1 from ways v join edges e on e.p = v.node where e.c not in (select id from loops)),
depth as (select node, max(d) as d from ways group by node),
p as (select * from pn where item in (select id from ids)), r as (select * from rn where item in (select id from ids)),
pairs as (select distinct p.item as a, r.item as b from p join r using (image_id)),
sim as (select a, b, max(case when coalesce(da.d, 0) + coalesce(db.d, 0) = 0 then 1.0 else 2.0 * coalesce(dx.d, 0) / (coalesce(da.d, 0) + coalesce(db.d, 0)) end) as lca, 1.0 / (1.0 + min(x.near + y.near)) as near from pairs join reach x on x.node = a join reach y on y.node = b and y.anc = x.anc
  left join depth dx on dx.node = x.anc left join depth da on da.node = a left join depth db on db.node = b group by a, b),
img as (select distinct image_id from (select image_id from pn where item in (select id from ids) union select image_id from rn where item in (select id from ids))),
m as (select p.image_id, p.item as a, r.item as b, coalesce(lca, 0) as lca, coalesce(near, 0) as near from p join r using (image_id) left join sim on sim.a = p.item and sim.b = r.item),
ba as (select image_id, sum(l) as l, sum(n) as n from (select image_id, a, max(lca) as l, max(near) as n from m group by all) group by 1),
bb as (select image_id, sum(l) as l, sum(n) as n from (select image_id, b, max(lca) as l, max(near) as n from m group by all) group by 1),
cnt as (select image_id, (select count(*) from p where p.image_id = img.image_id) as np, (select count(*) from r where r.image_id = img.image_id) as nr from img)
select image_id, round(case when np = 0 or nr = 0 then 0.0 else (ba.l + bb.l) / (np + nr) end, 6)::double as lca_similarity, round(case when np = 0 or nr = 0 then 0.0 else (ba.n + bb.n) / (np + nr) end, 6)::double as distance_similarity
from cnt left join ba using (image_id) left join bb using (image_id)""",
        "common_ancestors": f"""with recursive {onto(base)}, {node_sets},
w(node, anc, d) as (select id, id, 0::bigint from ids union select e.c, w.anc, w.d + 1 from w join edges e on e.p = w.node where w.d < 60),
reach as (select node, anc, min(d) as near from w group by all),
loops as (select distinct e.p as id from edges e join reach r on r.node = e.p and r.anc = e.c),
ways(node, d) as (select id, 0::bigint from roots where id not in (select id from loops) union select e.c, v.d + 1 from ways v join edges e on e.p = v.node where e.c not in (select id from loops)),
depth as (select node, max(d) as d from ways group by node), named as (select id, min(name) as name from onto_nodes group by id),
pairs as (select distinct p.item as a, r.item as b from pn p join rn r using (image_id) where p.item in (select id from ids) and r.item in (select id from ids))
select a, b, x.anc as lca_id, min(x.near + y.near) over (partition by a, b)::bigint as distance from pairs join reach x on x.node = a join reach y on y.node = b and y.anc = x.anc left join depth d on d.node = x.anc left join named n on n.id = x.anc
qualify row_number() over (partition by a, b order by coalesce(d.d, 0) desc, coalesce(n.name, '') desc, x.anc desc) = 1""",
        "entity_aggregate": f"""with e as (select image_id, {norm('label')} as label, max(confidence) as confidence, count(*) as n, min((ord, det_id)) as f from {dets} where image_id is not null and label is not null group by all)
select image_id, 'e' || row_number() over (partition by image_id order by f, label) as id, label, {cat('label')} as category, n as count_estimate, confidence from e""",
        "grounding_matches": f"""with {boxes}, m as (select a.row_id as box_id, b.row_id as match_id, {iou('a.', 'b.')} as iou from boxes a join boxes b on a.pred_id = b.pred_id and a.ord % 2 = 1 and b.ord % 2 = 0)
select box_id, match_id, round(iou, 6)::double as iou from m where iou >= 0.2 qualify row_number() over (partition by box_id order by iou desc, match_id) = 1""",
        "interactions_top": f"""select pred_id, subject_id, verb, object_id, row_id from {once('interactions', 'row_id')} where subject_id is not null and object_id is not null
qualify row_number() over (partition by pred_id, subject_id, object_id order by coalesce(confidence, 0) desc, ord, row_id) = 1""",
        "spatial_relations": f"""with {boxes}, {geo('boxes')},
e as (select * from geo2 where sal >= 0.30 and label not in {_list(dims.SPATIAL_LABELS['background'])} and (label in {_list(dims.SPATIAL_LABELS['compact'] + dims.SPATIAL_LABELS['structure'])} or size <> 'dominant')),
p as (select a.pred_id, a.row_id as s, b.row_id as o, abs((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) / {width} as dx, abs((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) / {height} as dy, {iou('a.', 'b.')} as ov,
  (a.x1 + a.x2) / 2 < (b.x1 + b.x2) / 2 as l, (a.y1 + a.y2) / 2 < (b.y1 + b.y2) / 2 as u from e a join e b on a.pred_id = b.pred_id and a.row_id < b.row_id),
c as (select pred_id, s, o, 'overlapping' as relation, least(ov, 1.0) as conf, 0 as k from p where ov >= 0.35
  union all select pred_id, s, o, case when l then 'left_of' else 'right_of' end, least(dx, 1.0), 1 from p where dx >= 0.15 and dx >= dy
  union all select pred_id, s, o, case when u then 'above' else 'below' end, least(dy, 1.0), 2 from p where dy >= 0.15 and dy > dx),
t as (select * from c where conf >= 0.15 qualify row_number() over (partition by pred_id, s, o order by conf desc, k) = 1)
select s::varchar as subject_id, relation, o::varchar as object_id, (floor(conf * 1000000.0 + 0.5) / 1000000.0)::double as confidence, row_number() over (partition by pred_id, s order by conf desc, o) as rnk from t qualify rnk <= 3""",
        "semantic_importance": f"with {boxes}, {geo('boxes')} select row_id, floor(greatest(0, least(1, 0.45::double * sal + 0.30::double * {_get(dims.CATEGORY_WEIGHTS, cat('label'))}::double + 0.20::double * 0 + 0.05::double * case when ord = 0 then 1.0 else 0.0 end)) * 10000 + 0.5) / 10000::double as importance from geo2",
        "visual_captions": f"""select pred_id, regexp_replace(trim('The image shows ' || {phrase} || case when len(t) = 0 then '' else ' with ' || ({join_list.format('t', ', and ')}) end), '[.]+$', '') || '.' as caption
from (select pred_id, scene, coalesce(list_filter(visual_terms, lambda x: x is not null), [])[1:8] as t from {preds} where scene.label is not null)""",
        "acoustic_captions": f"""with n as (select pred_id, coalesce(confidence, -1.0) as c, try_cast(regexp_extract(node_id, '[0-9]+') as bigint) as o, lower(trim(string_split(audioset_name, ',')[1])) as l, len(visual_evidence_terms) as k
  from {once('core_nodes', 'pred_id, node_id')} where audioset_name is not null and node_id is not null),
p as (select pred_id, c, o, case when k is null then l when k > 1 then l || 's' when left(l, 1) in ('a', 'e', 'i', 'o', 'u') then 'an ' || l else 'a ' || l end as s from n),
g as (select pred_id, list(s order by c desc, o, s) as t from p group by pred_id) select pred_id, ({join_list.format('t', ', and ')}) || ' would plausibly be heard.' as acoustic_caption from g""",
        "descriptions": f"""with d as (select pred_id, coalesce({emb('scene.label')}, '') as s, coalesce({emb('scene.indoor_outdoor')}, '') as i, list_sort(list_distinct(list_filter(list_transform(coalesce(visual_terms, []), lambda t: {emb('t')}), lambda t: t <> ''))) as t from {preds})
select pred_id, coalesce(nullif(concat_ws(' ', case when s <> '' then 'The image shows a ' || s || case when i <> '' then ' scene in an ' || i || ' setting.' else ' scene.' end end,
  case when len(t) > 0 then 'Visible entities include ' || ({join_list.format('t', ' and ')}) || '.' end), ''), 'No structured visual content is available.') as text from d""",
        "set_prf": f"with {sets} select pred_id, {prf('pred', 'ref')} from preds",
        "set_prf_by_condition": f"""with {sets}, m as (select detector, scene_model, captioner, case when len(pred) = 0 and len(ref) = 0 then 1.0 when len(pred) = 0 or len(ref) = 0 then 0.0 else len(list_intersect(pred, ref))::double / len(pred) end as p,
  case when len(pred) = 0 and len(ref) = 0 then 1.0 when len(pred) = 0 or len(ref) = 0 then 0.0 else len(list_intersect(pred, ref))::double / len(ref) end as r,
  case when len(pred) = 0 and len(ref) = 0 then 1.0 when len(pred) = 0 or len(ref) = 0 then 0.0 else 2.0 * len(list_intersect(pred, ref)) / (len(pred) + len(ref)) end as f from preds)
select detector, scene_model, captioner, count(*) as n, round(avg(p), 6)::double as precision, round(avg(r), 6)::double as recall, round(avg(f), 6)::double as f1 from m group by all""",
        "weighted_prf": f"with {sets} select pred_id, {wprf('pred', 'ref', weigh(label_w), '')} from preds".replace(" as precision", " as weighted_precision").replace(" as recall", " as weighted_recall").replace(" as f1", " as weighted_f1"),
        "label_families": f"with l as (select distinct {folded('label')} as label from entities where {folded('label')} <> '') select label, {family('label')} as family, {family('label', dims.SCENE_FAMILY_OF)} as scene_family, {label_w('label')}::double as weight, {cat('label')} as category from l",
        "verb_families": f"with v as (select distinct {folded('verb')} as verb from interactions where {folded('verb')} <> '') select verb, coalesce({_get(dims.VERB_FAMILY_OF, 'verb')}, '{dims.OTHER_VERB}') as family, coalesce({_get(dims.VERB_FORMS, 'verb')}, verb) as form from v",
        "family_counts": f"with {sets} select pred_id, fam as family, n from {fam_rows('pred')}",
        "family_metrics": f"""with {sets}, b as (select coalesce(p.pred_id, r.pred_id) as pred_id, coalesce(p.fam, r.fam) as fam, p.n as p, r.n as r from {fam_rows('pred')} p full join {fam_rows('ref')} r on p.pred_id = r.pred_id and p.fam = r.fam),
k as (select *, {fam_w('fam')} as w, fam in {_list(dims.DISCRETE_FAMILIES)} as d, (case when coalesce(p, 0) <= 0 then 0 when p = 1 then 1 when p <= 3 then 2 when p <= 10 then 3 else 4 end) = (case when coalesce(r, 0) <= 0 then 0 when r = 1 then 1 when r <= 3 then 2 when r <= 10 then 3 else 4 end) as same from b),
g as (select pred_id, count(*) as n, count(*) filter (same) as ns, sum(w) as sw, coalesce(sum(w) filter (same), 0) as ws, count(*) filter (d and r is not null) as dr, count(*) filter (d and r is not null and p is not null) as dh,
  sum(w) filter (d and r is not null) as wr, coalesce(sum(w) filter (d and r is not null and p is not null), 0) as wh, list(fam) filter (p is not null) as pf, list(fam) filter (r is not null) as rf from k group by pred_id),
a as (select p.pred_id, g.* exclude (pred_id, pf, rf), coalesce(pf, []) as pf, coalesce(rf, []) as rf from preds p left join g on g.pred_id = p.pred_id)
select pred_id, round(coalesce(ns / n, 1.0), 6)::double as count_bin_accuracy, round(coalesce(ws / sw, 1.0), 6)::double as weighted_count_bin_accuracy, round(case when coalesce(dr, 0) = 0 then 1.0 else dh / dr end, 6)::double as discrete_presence_recall,
  round(coalesce(wh / wr, 1.0), 6)::double as weighted_discrete_presence_recall, {prf('pf', 'rf', 'family_')}, {wprf('pf', 'rf', weigh(fam_w), 'weighted_family_')} from a""",
        "scene_evidence": f"""with {sets}, f as (select pred_id, fam, n from {fam_rows('pred', dims.SCENE_FAMILY_OF)}),
s as (select p.pred_id, {group} as g, {lower_io} as l, scene.indoor_outdoor as io from preds p),
t as (select s.pred_id, sum(case when s.g || '|' || f.fam in {_list(expected)} then {fam_w('f.fam')} * greatest(n, 1) else 0 end) / sum({fam_w('f.fam')} * greatest(n, 1)) as score from s join f using (pred_id) group by 1),
x as (select *, case when g in {_list(dims.INDOOR_GROUPS)} then 'indoor' when g is not null then 'outdoor' end as side, case when l like '%indoor%' then 'indoor' when l like '%outdoor%' then 'outdoor' when g in {_list(dims.INDOOR_GROUPS)} then 'indoor' when g is not null then 'outdoor' else 'unknown' end as inf from s)
select x.pred_id, coalesce(g, 'unknown') as scene_group, coalesce({_get(dims.AMBIENCE, 'g')}, 'unknown') as ambience, (case when io = side or inf = side then 1.0 else 0.0 end)::double as io_consistency, round(coalesce(score, 0.0), 6)::double as score from x left join t using (pred_id)""",
        "chair_v2": f"""with recursive {sets}, obj as (select distinct unnest(ref) as o from refs),
named as (select o, {singular('o')} as name from obj), voc as (select distinct name, len(string_split(name, ' ')) as n from named where name <> '' and o not in {_list(stop_words + dims.TEMPLATE_WORDS)} and name not in {_list(stop_words + dims.TEMPLATE_WORDS)}
  and not list_has_any(string_split(name, ' '), [{", ".join(f"'{w}'" for w in dims.TEMPLATE_WORDS)}])),
s as (select pred_id, ' ' || array_to_string({words('searched')}, ' ') || ' ' as t from {search}),
hit as (select pred_id, name, row_number() over (partition by pred_id order by n desc, name) as k from s join voc on contains(t, ' ' || name || ' ')),
walk(pred_id, k, t, m) as (select pred_id, 0::bigint, t, []::varchar[] from s union all
  select w.pred_id, h.k, case when contains(w.t, ' ' || h.name || ' ') then regexp_replace(w.t, ' ' || h.name || '( ' || h.name || ')* ', ' | ', 'g') else w.t end,
    case when contains(w.t, ' ' || h.name || ' ') then list_append(w.m, h.name) else w.m end from walk w join hit h on h.pred_id = w.pred_id and h.k = w.k + 1),
done as (select distinct on (pred_id) pred_id, list_sort(m) as m from walk order by pred_id, k desc),
r as (select d.pred_id, m, list_filter(m, lambda x: not list_contains(list_transform(ref, lambda o: {singular('o')}), x)) as bad from done d join preds using (pred_id))
select pred_id, array_to_string(m, '|') as mentioned, round(case when len(m) = 0 then 0.0 else len(bad)::double / len(m) end, 6)::double as chair_i, len(bad)::bigint as n_hallucinated, len(m)::bigint as n_mentioned from r""",
        "chair_v1": f"""with {sets}, voc as (select distinct unnest(ref) as name from refs), c as (select pred_id, ' ' || array_to_string(w, ' ') || ' ' as t, ref from {loose}),
f as (select pred_id, list_sort(list(name)) as m from c join voc on contains(t, ' ' || name || ' ') or contains(t, ' ' || name || 's ') group by pred_id),
r as (select c.pred_id, coalesce(m, []) as m, list_filter(coalesce(m, []), lambda x: not list_contains(ref, x)) as bad from c left join f using (pred_id))
select pred_id, array_to_string(m, '|') as mentioned, round(case when len(m) = 0 then 0.0 else len(bad)::double / len(m) end, 6)::double as chair_i, len(bad)::bigint as n_hallucinated, len(m)::bigint as n_mentioned from r""",
        "cider": _cider(_TOKENS) + "select pred_id, round(10 * sum(s) / count(distinct ref), 4)::double as cider from scored group by pred_id",
        "cider_untokenised": _cider("list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')") + "select pred_id, round(10 * sum(s) / count(distinct ref), 4)::double as cider from scored group by pred_id",
        "cider_by_condition": _cider(_TOKENS) + """, each as (select pred_id, 10 * sum(s) / count(distinct ref) as x from scored group by pred_id)
select detector, scene_model, captioner, count(*) as n_caption_refs, round(avg(x), 4)::double as cider from each join cands using (pred_id) group by all""",
        "embedding_cosine": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5)::double as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
        "payload_validation": f"""with {bodies}, x as (select nested_id, j, {arr('$.core.nodes')} as nodes, {arr('$.extended.grounding')} as boxes, {arr('$.core.entities')} as ents, {arr('$.core.observed_interactions')} as acts,
  case when json_type(j, '$.core.visual_terms') = 'ARRAY' then list_transform(json_extract(j, '$.core.visual_terms[*]'), lambda t: t->>'$') else [] end as said from bodies),
y as (select *, {txt('nodes', 'node_id')} as ni, {txt('boxes', 'node_id')} as bi, {txt('ents', 'id')} as ei, list_filter(list_transform(nodes, lambda e: case when json_type(e, '$.visual_evidence_terms') = 'ARRAY' then list_transform(json_extract(e, '$.visual_evidence_terms[*]'), lambda t: t->>'$') else [] end), lambda t: len(t) > 0) as terms from x)
select nested_id, case when json_exists(j, '$.core.nodes') then 'audioset' else 'legacy' end as kind, len(nodes)::bigint as n_nodes, len(boxes)::bigint as n_grounding, len(ents)::bigint as n_entities, len(acts)::bigint as n_interactions,
  len(list_filter(bi, lambda b: not list_contains(ni, b))) = 0 as grounding_node_id_consistency,
  round(case when len(terms) = 0 then 1.0 else len(list_filter(terms, lambda t: len(list_filter(t, lambda z: case when z is null then len(list_filter(said, lambda q: q is null)) = 0 else not list_contains(said, z) end)) = 0))::double / len(terms) end, 6)::double as terms_declared_ratio,
  round(case when len(acts) = 0 then 1.0 else len(list_filter(acts, lambda a: list_contains(ei, a->>'$.subject_id') and list_contains(ei, a->>'$.object_id') and coalesce(a->>'$.verb', '') <> ''))::double / len(acts) end, 6)::double as interaction_valid_ratio,
  coalesce(j->>'$.core.caption', '') <> '' as has_caption, j->>'$.core.scene.label' as scene_label from y""",
        "payload_entities": f"""with {bodies}, e as (select nested_id, unnest({arr('$.core.entities')}) as x, unnest(range(len({arr('$.core.entities')}))) as pos from bodies),
o as (select nested_id, x, row_number() over (partition by nested_id order by pos) as k, coalesce(nullif({norm("x->>'$.label'")}, ''), 'object') as label, {norm("x->>'$.category'")} as c from e where json_type(x) = 'OBJECT')
select nested_id, 'e' || k as id, label, case when c in {_list(dims.VALID_CATEGORIES)} then c else {cat('label')} end as category, greatest(1, coalesce(try_cast(x->>'$.count_estimate' as bigint), 1)) as count_estimate,
  greatest(0, least(1, coalesce(try_cast(x->>'$.confidence' as double), 0.5)))::double as confidence from o""",
    }
    sql |= {
        "prediction_evidence": f"""with s as (select pred_id, label as t from entities union all select pred_id, verb from interactions), f as (select pred_id, {folded('t')} as term from s union select pred_id, {canon('t')} from s)
select distinct pred_id, term from f where term is not null and term <> ''""",
        "predicted_nodes": f"""with {terms}, {rule_terms}, {usable}, fired as (select pred_id, rule_id from terms join rterms using (term) group by pred_id, rule_id, n_groups having count(distinct group_no) = n_groups)
select distinct pred_id, rule_id from (select pred_id, audioset_id as rule_id from core_nodes union all select pred_id, rule_id from fired) where rule_id in (select id from usable) or rule_id in (select rule_id from rules)""",
        "node_diagnostics": """with names as (select id, min(name) as name from onto_nodes group by id), i as (select distinct pred_id, audioset_id as id from core_nodes where audioset_id is not null)
select pred_id, string_agg(i.id, '|' order by i.id) as ids, string_agg(name, '|' order by name) as names from i left join names using (id) group by pred_id""",
        "manifest_summary": f"""with {bodies}, x as (select nested_id, j, json_exists(j, '$.core.nodes') as d from bodies)
select nested_id, case when d then 'audioset' else 'legacy' end as kind, j->>'$.core.image_id' as image_id, j->>'$.core.scene.label' as scene_label, try_cast(j->>'$.core.scene.confidence' as double) as scene_confidence, j->>'$.core.scene.indoor_outdoor' as indoor_outdoor, j->>'$.core.caption' as caption,
  case when d then len({arr('$.core.nodes')})::bigint end as n_nodes, case when d then len({arr('$.core.visual_terms')})::bigint end as n_visual_terms, case when not d then len({arr('$.core.entities')})::bigint end as n_entities, case when not d then len({arr('$.core.observed_interactions')})::bigint end as n_interactions,
  try_cast(j->>'$.extended.global_geometry.total_object_coverage' as double) as coverage, try_cast(j->>'$.extended.global_geometry.object_density_proxy' as double) as density from x""",
    }
    sql["chair_v2_by_condition"] = (
        sql["chair_v2"].replace("select pred_id, array_to_string(m", "select detector, scene_model, captioner, count(*) as n, count(*) filter (len(m) > 0) as n_chair, round(avg(len(bad)::double / len(m)) filter (len(m) > 0), 5)::double as chair_i, round(avg(len(m)), 5)::double as avg_mentioned, round(avg(len(bad)), 5)::double as avg_hallucinated from r join (select pred_id, detector, scene_model, captioner from preds) using (pred_id) group by all --", 1)
    )
    sql["metric_group_projection"] = f"select detector, scene_model, captioner, n, f1 from ({sql['set_prf_by_condition']})"
    return sql
