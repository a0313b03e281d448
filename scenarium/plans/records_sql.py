"""SQL (DuckDB's dialect) of the queries in ``records``, written apart from their plans."""

from __future__ import annotations

from scenarium import dims
from scenarium.plans.evaluation_sql import _get, _list, folded, norm, singular

CONDITION = "detector, scene_model, captioner"


def build(other: dict[str, str], aliases: dict, rules: list, scenes: dict, relevance: dict, tags: dict) -> dict[str, str]:
    """The queries' SQL; ``other``: that of the evaluation's queries."""
    canon = lambda x: f"coalesce({_get(aliases, folded(x))}, {folded(x)})"
    by_cat = {label: dims.CATEGORY_FAMILY[c] for label, c in dims.CATEGORY_OF.items()}
    family = lambda x, t: f"coalesce({_get(t, x)}, {_get(by_cat, x)})"
    fam_w = lambda x: f"coalesce({_get(dims.FAMILY_WEIGHTS, x)}, {dims.NO_FAMILY_WEIGHT})"
    label_w = lambda x: f"coalesce({_get(dims.LABEL_WEIGHT_OF, x)}, {fam_w(family(x, dims.SOUND_FAMILY_OF))})"
    arr = lambda p: f"(case when json_type(j, '{p}') = 'ARRAY' then list_filter(json_extract(j, '{p}[*]'), lambda x: json_type(x) = 'OBJECT') else [] end)"
    texts = lambda x, p: f"(case when json_type({x}, '{p}') = 'ARRAY' then list_transform(json_extract({x}, '{p}[*]'), lambda t: t->>'$') else [] end)"
    prf = lambda p, r, n: f"""
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else len(list_intersect({p}, {r}))::double / len({p}) end, 6)::double as {n}precision,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else len(list_intersect({p}, {r}))::double / len({r}) end, 6)::double as {n}recall,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else 2.0 * len(list_intersect({p}, {r})) / (len({p}) + len({r})) end, 6)::double as {n}f1"""  # noqa: E731
    total = lambda items, w: f"coalesce(list_sum(list_transform({items}, lambda x: {w('x')}))::double, 0)"
    wprf = lambda p, r, w, n: f"""
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else {total(f'list_intersect({p}, {r})', w)} / {total(p, w)} end, 6)::double as {n}precision,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else {total(f'list_intersect({p}, {r})', w)} / {total(r, w)} end, 6)::double as {n}recall,
round(case when len({p}) = 0 and len({r}) = 0 then 1.0 when len({p}) = 0 or len({r}) = 0 then 0.0 else 2 * {total(f'list_intersect({p}, {r})', w)} / ({total(p, w)} + {total(r, w)}) end, 6)::double as {n}f1"""  # noqa: E731
    bodies = """cleaned as (select distinct on (nested_id) nested_id, image_id, body is null as missing, ltrim(body, chr(65279) || ' ' || chr(10)) as b from nested_preds),
opened as (select * exclude (b), case when b[1] = '"' and json_valid(b) then b::json->>'$' else b end as b from cleaned),
bodies as (select nested_id, image_id, b::json as j from opened where json_valid(b) and json_type(b) = 'OBJECT')"""
    group = _get(scenes, norm("scene_label"))
    parsed = f"""with {bodies},
cond as (select image_id, arg_min(coalesce(detector, ''), pred_id) as detector, arg_min(coalesce(scene_model, ''), pred_id) as scene_model, arg_min(coalesce(captioner, ''), pred_id) as captioner from core_preds where image_id is not null group by image_id),
refs as (select image_id, list(distinct {canon('label')}) as ref from entities where image_id is not null and {folded('label')} <> '' group by image_id),
ents as (select distinct on (pred_id, id) pred_id, id, image_id, {canon('label')} as label from entities),
acts as (select distinct on (row_id) pred_id, subject_id, object_id, {canon('verb')} as verb from interactions),
told as (select s.image_id, list(distinct s.label || '::' || a.verb || '::' || o.label) as ref_triples, list(distinct a.verb) as ref_verbs from acts a join ents s on s.pred_id = a.pred_id and s.id = a.subject_id
  join ents o on o.pred_id = a.pred_id and o.id = a.object_id where a.verb <> '' and s.label <> '' and o.label <> '' and s.image_id is not null and o.image_id is not null group by s.image_id),
raw as (select nested_id, image_id, j, {arr('$.core.entities')} as es, {arr('$.core.observed_interactions')} as acs, {arr('$.core.nodes')} as ns, json_exists(j, '$.core.nodes') as audio, coalesce(j->>'$.core.scene.label', '') as scene_label,
  coalesce(j->>'$.core.scene.indoor_outdoor', 'unknown') as io, try_cast(j->>'$.core.scene.confidence' as double) as conf from bodies),
parsed as (
  select raw.*, coalesce(detector, 'unknown') as detector, coalesce(scene_model, 'unknown') as scene_model, coalesce(captioner, 'unknown') as captioner, coalesce(ref, []) as ref, coalesce(ref_triples, []) as ref_triples, coalesce(ref_verbs, []) as ref_verbs,
    list_transform(es, lambda e: {{'id': e->>'$.id', 'label': {canon("(e->>'$.label')")}, 'n': coalesce(try_cast(e->>'$.count_estimate' as bigint), 1)}}) as e,
    list_transform(acs, lambda a: {{'s': a->>'$.subject_id', 'v': {canon("(a->>'$.verb')")}, 'o': a->>'$.object_id'}}) as a,
    list_filter(list_transform({texts('j', '$.core.visual_terms')}, lambda t: {canon('t')}), lambda t: t is not null and t <> '') as terms,
    list_transform(flatten(list_transform(ns, lambda n: {texts('n', '$.visual_evidence_terms')})), lambda t: {canon('t')}) as evidence, {group} as grp
  from raw left join cond using (image_id) left join refs using (image_id) left join told using (image_id)
)
"""
    keys = f"nested_id, image_id, {CONDITION}"
    counts = lambda name, items, t: f"{name} as (select nested_id, {family('l', t)} as fam, sum(n) as n from (select nested_id, x.label as l, x.n as n from (select nested_id, unnest({items}) as x from parsed)) where {family('l', t)} is not null group by all)"
    ones = lambda c: f"list_transform({c}, lambda x: {{'label': x, 'n': 1::bigint}})"
    pairs = lambda c: f"list_transform({c}, lambda x: {{'label': x.label, 'n': x.n}})"
    expected = [f"{g}|{f}" for g, fs in dims.SCENE_EXPECTED.items() for f in fs]
    share = lambda src: f"(select p.nested_id, sum(case when p.grp || '|' || c.fam in {_list(expected)} then {fam_w('c.fam')} * greatest(c.n, 1) else 0 end) / sum({fam_w('c.fam')} * greatest(c.n, 1)) as x from parsed p join {src} c using (nested_id) group by 1)"
    l_ = norm("scene_label")
    inferred = f"case when {l_} like '%indoor%' then 'indoor' when {l_} like '%outdoor%' then 'outdoor' when grp in {_list(dims.INDOOR_GROUPS)} then 'indoor' when grp is not null then 'outdoor' else 'unknown' end"
    side = f"case when grp in {_list(dims.INDOOR_GROUPS)} then 'indoor' when grp is not null then 'outdoor' end"
    scene = parsed + f""", {counts('pc', f"case when audio then {ones('evidence')} else {pairs('e')} end", dims.SCENE_FAMILY_OF)}, {counts('rc', ones('ref'), dims.SCENE_FAMILY_OF)},
scene as (select {keys}, scene_label, coalesce(grp, 'unknown') as scene_group, coalesce(conf::decimal(12,4)::varchar, 'n/a') as scene_confidence, (grp is not null)::int::double as scene_group_known,
  (case when io = {side} or {inferred} = {side} then 1.0 else 0.0 end)::double as scene_indoor_outdoor_consistency, round(coalesce(p.x, 0), 6)::double as pred_entity_scene_consistency, round(coalesce(r.x, 0), 6)::double as gt_entity_scene_consistency
  from parsed left join {share('pc')} p using (nested_id) left join {share('rc')} r using (nested_id))
"""
    scene_means = f"select {CONDITION}, count(*) as n, " + ", ".join(
        f"round(avg(try_cast({c} as double)), 6)::double as {c}" for c in ("scene_confidence", "scene_group_known", "scene_indoor_outdoor_consistency", "pred_entity_scene_consistency", "gt_entity_scene_consistency")
    ) + f" from scene group by {CONDITION}"
    verb = lambda x: f"case when {x} <> '' then coalesce({_get(dims.VERB_FAMILY_OF, x)}, '{dims.OTHER_VERB}') end"
    bin_ = lambda x: f"(case when coalesce({x}, 0) <= 0 then 0 when {x} = 1 then 1 when {x} <= 3 then 2 when {x} <= 10 then 3 else 4 end)"
    disc = _list(dims.DISCRETE_FAMILIES)
    only = f"[{', '.join(repr(f) for f in dims.DISCRETE_FAMILIES)}]"
    sound = parsed + f""", {counts('pc', pairs('e'), dims.SOUND_FAMILY_OF)}, {counts('rc', ones('ref'), dims.SOUND_FAMILY_OF)},
b as (select coalesce(p.nested_id, r.nested_id) as nested_id, coalesce(p.fam, r.fam) as fam, p.n as p, r.n as r from pc p full join rc r on p.nested_id = r.nested_id and p.fam = r.fam),
g as (select nested_id, count(*) as n, count(*) filter ({bin_('p')} = {bin_('r')}) as ns, sum({fam_w('fam')}) as sw, coalesce(sum({fam_w('fam')}) filter ({bin_('p')} = {bin_('r')}), 0) as ws,
  count(*) filter (fam in {disc} and r is not null) as dn, count(*) filter (fam in {disc} and r is not null and p is not null) as dh, sum({fam_w('fam')}) filter (fam in {disc} and r is not null) as wr,
  coalesce(sum({fam_w('fam')}) filter (fam in {disc} and r is not null and p is not null), 0) as wh, list(fam) filter (p is not null) as pf, list(fam) filter (r is not null) as rf from b group by nested_id),
h as (select p.* exclude (ns), g.* exclude (nested_id, pf, rf), coalesce(pf, []) as pf, coalesce(rf, []) as rf, list_distinct(list_filter(list_transform(e, lambda x: x.label), lambda x: x is not null and x <> '')) as own,
  list_distinct(list_filter(list_transform(a, lambda x: {verb('x.v')}), lambda x: x is not null)) as vp, list_distinct(list_filter(list_transform(ref_verbs, lambda x: {verb('x')}), lambda x: x is not null)) as vr,
  coalesce({_get(dims.AMBIENCE, 'grp')}, 'unknown') as back from parsed p left join g using (nested_id)),
k as (select *, list_intersect(pf, {only}) as dp, list_intersect(rf, {only}) as dr from h),
sound as (select {keys}, scene_label, coalesce(grp, 'unknown') as scene_family, back as background_family, (grp is not null)::int::double as scene_family_known, (back <> 'unknown')::int::double as background_family_known, io as indoor_outdoor,
  (io <> 'unknown' or {inferred} <> 'unknown')::int::double as indoor_outdoor_known, {prf('own', 'ref', 'entity_exact_')}, {wprf('own', 'ref', label_w, 'weighted_entity_exact_')}, {prf('pf', 'rf', 'entity_family_')}, {wprf('pf', 'rf', fam_w, 'weighted_entity_family_')},
  {prf('dp', 'dr', 'discrete_family_')}, {wprf('dp', 'dr', fam_w, 'weighted_discrete_family_')}, round(coalesce(ns / n, 1.0), 6)::double as family_count_bin_accuracy, round(coalesce(ws / sw, 1.0), 6)::double as weighted_family_count_bin_accuracy,
  round(case when coalesce(dn, 0) = 0 then 1.0 else dh / dn end, 6)::double as weighted_discrete_presence_recall, round(coalesce(wh / wr, 1.0), 6)::double as acoustic_weighted_discrete_presence_recall, {prf('vp', 'vr', 'interaction_family_')},
  len(pf)::bigint as n_pred_families, len(rf)::bigint as n_gt_families, len(dp)::bigint as n_pred_discrete_families, len(dr)::bigint as n_gt_discrete_families, len(vp)::bigint as n_pred_interaction_families, len(vr)::bigint as n_gt_interaction_families from k)
"""
    figures = ["weighted_entity_family_f1", "weighted_discrete_family_f1", "acoustic_weighted_discrete_presence_recall", "interaction_family_f1"]
    label_of = "list_extract(list_filter(e, lambda x: x.id = {0} and x.id <> '' and x.label <> ''), -1).label"
    chair = other["chair_v2"].split("r as (select d.pred_id")[0]
    pairs_of = {f"{g}|{label}": x for g, of in relevance.items() for label, x in of.items()}
    near = "[" + ", ".join(f"struct_pack(term := '{t}', tags := {own})" for t, own in tags.items()) + "]"
    exact = "map {" + ", ".join(f"'{t}': {own}" for t, own in tags.items()) + "}"
    importance = other["semantic_importance"]
    relevant = f"coalesce({_get(pairs_of, "(s.grp || '|' || label)")}, 0.0)"
    sql = {
        "structured_metrics": parsed
        + f""", t as (select *, list_distinct(list_filter(case when audio then terms else list_transform(e, lambda x: x.label) end, lambda x: x is not null and x <> '')) as own,
  list_distinct(list_filter(list_transform(a, lambda y: {label_of.format('y.s')} || '::' || nullif(y.v, '') || '::' || {label_of.format('y.o')}), lambda x: x is not null)) as tr from parsed)
select {keys}, {prf('own', 'ref', 'entity_')}, {prf('tr', 'ref_triples', 'relationship_')} from t""",
        "scene_records": scene + "select * from scene",
        "scene_records_by_condition": scene + scene_means,
        "report_scene": scene + f"select {CONDITION}, scene_group_known, pred_entity_scene_consistency, n from ({scene_means})",
        "soundscape_records": sound + "select * from sound",
        "report_soundscape": sound + f"select {CONDITION}, count(*) as n, " + ", ".join(f"round(avg({c}), 4)::double as {c}" for c in figures) + f" from sound group by {CONDITION}",
        "chair_by_condition": chair
        + f"""r as (select p.*, m, list_filter(m, lambda x: not list_contains(list_transform(ref, lambda o: {singular('o')}), x)) as bad, case when visual_terms is not null then list_filter(m, lambda x: not list_contains(list_transform(pred, lambda o: {singular('o')}), x)) end as worse from done d join preds p using (pred_id))
select {CONDITION}, round(avg(len(bad)::double / len(m)) filter (len(m) > 0), 6)::double as CHAIRi_VG, round(avg(len(worse)::double / len(m)) filter (len(m) > 0), 6)::double as CHAIRi_JSON, round(avg(len(m)), 6)::double as avg_caption_objects_mentioned,
  round(avg(len(bad)), 6)::double as avg_hallucinated_vg, round(avg(len(worse)), 6)::double as avg_hallucinated_json, count(*) filter (len(m) > 0) as n_chair, count(*) as n from r group by {CONDITION}""",
        "report_caption": f"select {CONDITION}, cider as CIDEr, null::double as SPICE, n_caption_refs as n from ({other['cider_by_condition']})",
        "report_audioset": f"""select {CONDITION}, round(avg(node_f1), 6)::double as audioset_exact_node_f1, round(avg(parent_f1), 6)::double as audioset_parent_f1, round(avg(top_f1), 6)::double as audioset_top_level_f1,
  round(avg(lca_similarity), 6)::double as audioset_lca_similarity, round(avg(distance_similarity), 6)::double as audioset_tree_distance_similarity, count(*) as n
from ({other['hierarchical_prf']}) a left join ({other['best_similarity']}) b using (image_id)
join (select image_id, arg_min(coalesce(detector, ''), pred_id) as detector, arg_min(coalesce(scene_model, ''), pred_id) as scene_model, arg_min(coalesce(captioner, ''), pred_id) as captioner from core_preds where image_id is not null group by image_id) c using (image_id)
group by {CONDITION}""",
        "label_tags": f"""select label, array_to_string(list_sort(list_distinct(case when map_contains({exact}, label) then map_extract({exact}, label)[1] else flatten(list_transform(list_filter({near}, lambda x: contains(label, x.term)), lambda x: x.tags)) end)), '|') as tags
from (select distinct {folded('label')} as label from detections) where label <> ''""",
        "importance_in_scene": importance.replace("0.20::double * 0 ", f"0.20::double * {relevant} ").replace("select row_id, floor", f"select row_id, {relevant}::double as scene_relevance, floor").replace(
            "from geo2", f"from geo2 left join (select distinct on (pred_id) pred_id, {_get(scenes, norm('scene.label'))} as grp from core_preds) s using (pred_id)"
        ),
        "validation_records": f"""with {bodies}, ids as (select distinct id from onto_nodes where id is not null),
v as ({other['payload_validation']}),
m as (select nested_id, json_exists(j, '$.core.nodes') as audio, case when json_type(j, '$.core.nodes') = 'ARRAY' then list_transform(json_extract(j, '$.core.nodes[*]'), lambda x: trim(x->>'$.audioset_id')) else [] end as nid,
  case when json_type(j, '$.core.entities') = 'ARRAY' then list_transform(json_extract(j, '$.core.entities[*]'), lambda x: x->>'$.id') else [] end as own,
  case when json_type(j, '$.extended.entities_extended') = 'ARRAY' then list_transform(json_extract(j, '$.extended.entities_extended[*]'), lambda x: x->>'$.id') else [] end as ext,
  case when json_type(j, '$.core.visual_terms') = 'ARRAY' then json_array_length(j, '$.core.visual_terms') else 0 end as nt, try_cast(j->>'$.core.scene.confidence' as double) as conf from bodies),
hit as (select nested_id, count(*) as n_hit from (select nested_id, unnest(nid) as id from m) where id in (select id from ids) group by 1)
select c.nested_id, c.image_id, v.kind is not null as json_valid, case when v.kind is not null then '' when c.missing then 'no body' else 'no readable JSON object' end as json_error, v.kind, case when audio then n_nodes end as n_nodes,
  case when audio then n_grounding end as n_grounding, case when audio then grounding_node_id_consistency end as grounding_node_id_consistency,
  case when audio then round(case when n_nodes = 0 then 1.0 else coalesce(n_hit, 0)::double / n_nodes end, 6)::double end as audioset_id_valid_ratio, case when audio then terms_declared_ratio end as visual_evidence_terms_subset_of_visual_terms_ratio,
  case when audio then nt::bigint end as n_visual_terms, case when not audio then n_entities end as n_entities, case when not audio then len(ext)::bigint end as n_entities_extended, case when not audio then n_interactions end as n_interactions,
  case when not audio then interaction_valid_ratio end as interaction_valid_ratio, case when not audio then len(ext) = 0 or len(list_filter(own, lambda x: not list_contains(ext, x))) = 0 end as entity_id_consistency, has_caption,
  case when v.kind is not null then coalesce(scene_label, '') end as scene_label, round(conf, 6)::double as scene_confidence
from (select distinct on (nested_id) nested_id, image_id, missing from cleaned) c left join v using (nested_id) left join m using (nested_id) left join hit using (nested_id)""",
    }
    strong = "visual_label_raw is not null and coalesce(detector_confidence, 0.0) >= 0.2"
    nms = other["nms_kept"].replace("visual_label_raw is not null", strong).replace(">= 0.3)", ">= 0.85)")
    boxes = other["box_overlaps"].split("boxes as (")[1].split("\n)")[0]
    emb = lambda x: f"trim(regexp_replace(translate(lower(trim({x})), '_-/', '   '), '\\s+', ' ', 'g'))"
    row = lambda x, sep, none, head="": f"case when len(list_filter(list_transform({x}, lambda t: {emb('t')}), lambda t: t <> '')) = 0 then '{none}' else '{head}' || array_to_string(list_sort(list_distinct(list_filter(list_transform({x}, lambda t: {emb('t')}), lambda t: t <> ''))), '{sep}') end"
    told = {i: " AND ".join(f"({' OR '.join(g.split(' or '))})" if " or " in g else g for g in e.split(" and ")) for i, _, e in rules}
    sql |= {
        "suppressed_boxes": other["alias_kept"].replace("visual_label_raw is not null", f"{strong} and row_id in ({nms})"),
        "strong_detections": "select coalesce(source, '') as source, count(*) as n, count(distinct image_id) as n_images from (select distinct on (det_id) * from detections) where confidence >= 0.2 and not isnan(confidence) group by 1",
        "box_forms": f"""with boxes as ({boxes})
select row_id, round(x1 - x2 / 2, 4)::double as c_x1, round(y1 - y2 / 2, 4)::double as c_y1, round(x1 + x2 / 2, 4)::double as c_x2, round(y1 + y2 / 2, 4)::double as c_y2, round(x1 * 2.0, 4)::double as s_x1, round(y1 * 0.5, 4)::double as s_y1, round(x2 * 2.0, 4)::double as s_x2, round(y2 * 0.5, 4)::double as s_y2 from boxes""",
        "strict_matches": other["grounding_matches"].replace("and a.ord % 2 = 1 and b.ord % 2 = 0", "and a.row_id <> b.row_id").replace("iou >= 0.2", "iou > 0.2"),
        "environments": f"""with e as (select pred_id, sum(case when coalesce({_get(dims.CATEGORY_OF, norm('label'))}, 'object') = 'human' then coalesce(count_estimate, 1) else 0 end) as h from (select distinct on (pred_id, id) * from entities) where label is not null group by pred_id),
a as (select pred_id, count(distinct row_id) as n from interactions group by pred_id)
select pred_id, case when h <= 0 then 'empty' when h <= 2 then 'sparse' else 'moderate' end as crowd_level, case when n > 0 then 'medium' else 'low' end as activity_level, 'unknown' as lighting from e left join a using (pred_id)""",
        "encoder_texts": parsed + f"""select nested_id, case when scene_label = '' then 'unknown scene' when {emb('io')} <> '' then {emb('scene_label')} || ' ' || {emb('io')} || '.' else {emb('scene_label')} end as scene,
  {row('case when audio then terms else list_transform(e, lambda x: x.label) end', ' ', 'entities: none')} as entities, {row('ref', ' ', 'entities: none')} as ref_entities,
  {row("list_transform(ref_triples, lambda x: replace(x, '::', ' '))", ' ; ', 'interactions: none', 'interactions: ')} as ref_interactions from parsed""",
        "rule_texts": "select rule_id, name, rule, 'Name the nodes whose rule the visual_terms satisfy, as JSON under nodes. Rules: ' || name || ': ' || rule || '.' as prompt from (values " + ", ".join(f"('{i}', '{n}', '{told[i]}')" for i, n, _ in rules) + ") t(rule_id, name, rule)",
        "node_paths": """with recursive ids as (select distinct id from onto_nodes where ontology_id = 'base' and id is not null),
edges as (select distinct n.id as p, u.c as c from onto_nodes n, unnest(n.child_ids) as u(c) where n.ontology_id = 'base' and n.id is not null and u.c in (select id from ids)),
reach(a, b) as (select p, c from edges union select r.a, e.c from reach r join edges e on r.b = e.p), cyc as (select a as id from reach where a = b), named as (select id, min(name) as name from onto_nodes where id is not null group by id),
ways(node, path) as (
  select id, name from ids join named using (id) where id not in (select c from edges) and id not in (select id from cyc)
  union all select e.c, w.path || ' > ' || n.name from ways w join edges e on e.p = w.node join named n on n.id = e.c where e.c not in (select id from cyc)
)
select node, string_agg(path, ' / ' order by path) as paths from ways group by node""",
        "node_counts": """with u as (select id from onto_nodes where ontology_id = 'base' and id is not null group by id having not list_has_any(flatten(list(coalesce(restrictions, []))), ['blacklist', 'abstract'])),
c as (select coalesce(p.captioner, '') as captioner, n.audioset_id as id, count(*) as k from (select distinct on (pred_id, node_id) * from core_nodes) n join (select distinct on (pred_id) * from core_preds) p using (pred_id) where n.audioset_id in (select id from u) group by all)
select captioner, string_agg(id || ':' || k, '|' order by k desc, id) as node_counts from c group by captioner""",
        "clip_scores": """select a.vec_id % 10 as part, count(*) as n, round(avg(greatest(0.0, 100.0 * list_cosine_similarity(a.embedding::double[], b.embedding::double[]))), 4)::double as CLIPScore
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 group by 1""",
    }
    sql["report_chair"] = f"select {CONDITION}, CHAIRi_VG, CHAIRi_JSON, avg_caption_objects_mentioned, avg_hallucinated_vg, avg_hallucinated_json, n from ({sql['chair_by_condition']})"
    return sql
