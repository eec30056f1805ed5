"""Queries of the corpus operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import re

from . import ann, bpe, chat, counts, divergence, jaccard, lm, manifest, neardup, packing, quality, sharding, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_chat": chat.op3_chat,
    "op4_ann": ann.op4_ann,
    "op5_quality": quality.op5_quality,
    "op6_sharding": sharding.op6_sharding,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_lm": lm.op9_lm,
    "op10_neardup": neardup.op10_neardup,
    "op11_counts": counts.op11_counts,
    "op12_divergence": divergence.op12_divergence,
    "op13_manifest": manifest.op13_manifest,
}
_JACCARD = r"""
with recursive w as (select doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where k / (x.n + y.n - k)::double >= 0.8),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a),
c as (select a as doc_id, min(b) as class_id from r group by 1),
t as (select doc_id, text, min(doc_id) over (partition by text) as copy_of from documents),
k as (select l.a as doc_id, count(*) as n_links, count(distinct case when x.copy_of <> y.copy_of then y.copy_of end) as n_text_links from l join t x on x.doc_id = l.a join t y on y.doc_id = l.b group by 1)
select doc_id, class_id, coalesce(n_links, 0)::bigint as n_links, coalesce(n_text_links, 0)::bigint as n_text_links, copy_of from c join t using (doc_id) left join k using (doc_id)"""

_PATTERN = "|".join(re.escape(x) for x in chat.CONTROL)
_CHAT = f"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 sum({len(chat.TURN + chat.SAYS + chat.END)} + length(role) + length(text) + 2 * len(regexp_extract_all(text, '{_PATTERN}')) + len(regexp_extract_all(text, '{chat.ESCAPE}')))::bigint as formatted_chars
from t group by conv_id"""

_VECTORS = """
with recursive every as (select row_number() over () as i, vec_id, embedding::double[] as e from embeddings),
v as (select * from every where vec_id is not null and len(e) > 0 and list_count(e) = len(e) and len(list_filter(e, lambda x: not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.i as a, b.i as b, b.vec_id from v a join v b on a.i <> b.i and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select i as a, i as b from every union select r.a, l.b from r join l on r.b = l.a),
c as (select r.a as i, min(x.vec_id) as component_id from r join every x on x.i = r.b group by 1), n as (select a as i, count(*) as n from l group by 1)
select x.vec_id, coalesce(n, 0)::bigint as n_links, component_id, x.vec_id = component_id as kept from every x join c using (i) left join n using (i)"""

_NEAREST = """
with v as (select row_number() over () as i, vec_id, embedding::double[] as e from embeddings where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select q.i, q.vec_id as query_id, v.vec_id, list_cosine_similarity(q.e, v.e) as score from v as q join v on q.i <> v.i and len(q.e) = len(v.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by i order by score desc, vec_id) as rank from p)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""

_DIVERGENCE = f"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{manifest.UPPER}', '{manifest.LOWER}') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
k as (select lang, term, count(*) as n from w group by all having count(distinct i) >= 10), v as (select lang, count(*) as v, sum(n) as n from k group by 1),
c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all), t as (select lang, source, sum(n) as n from c group by all),
g as (select distinct d.lang, d.source, coalesce(v.v, 0)::hugeint as v, coalesce(v.n, 0)::hugeint as ln, coalesce(t.n, 0)::hugeint as n from d left join v using (lang) left join t using (lang, source)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) as p, 1 + (1000000000::hugeint * (k.n + 2)) // (g.ln + 2 * g.v) as q from g join k using (lang) left join c using (lang, source, term)),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((p.p - r.p) * (p.p - r.p) // (p.p + r.p)), 0)::bigint as value
 from g a join g b on a.lang = b.lang and a.source <> b.source left join p on p.lang = a.lang and p.source = a.source left join p r on r.lang = b.lang and r.source = b.source and r.term = p.term group by all
 union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p where c > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 10"""


def _merkle() -> str:
    """The manifest with one step for each level, for trees of up to 8^8 leaves."""
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda s: ascii(s)::bigint)), lambda c, b: xor(c // 256, list_reduce(list_prepend(xor(c, b) % 256, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x // 2, 3988292384 * (x % 2))))))"
    field = lambda c, of: f"coalesce(strlen({of}::varchar) || ':' || {of}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c, text if c == "text" else c) for c in manifest.FIELDS) + ")"
    steps = [
        f"d as (select *, {leaf('text')} as leaf, case when ({crc}) % 3 = 0 then {leaf(f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')")} else {leaf('text')} end as back from documents)",
        "l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d)",
        "a0 as (select lang, pos, leaf as h from l)",
    ]
    link = lambda a, b: f"{a}.lang is not distinct from {b}.lang"
    levels = 8
    for i in range(levels):
        steps += [
            f"n{i} as (select *, count(*) over (partition by lang) as n from a{i})",
            f"a{i + 1} as (select lang, pos // 8 as pos, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end as h from n{i} group by lang, pos // 8)",
            f"s{i} as (select x.lang, x.pos, any_value(x.n) as n, coalesce(string_agg(y.h, '' order by y.pos) filter (y.pos < x.pos), '') as before, coalesce(string_agg(y.h, '' order by y.pos) filter (y.pos > x.pos), '') as after from n{i} x join n{i} y on {link('x', 'y')} and x.pos // 8 = y.pos // 8 group by x.lang, x.pos)",
        ]
    steps += [f"b0 as (select lang, row_number() over (order by lang nulls first) - 1 as pos, h as subroot from a{levels})", "u0 as (select pos, subroot as h from b0)"]
    for i in range(3):
        steps += [
            f"w{i} as (select *, count(*) over () as n from u{i})",
            f"u{i + 1} as (select pos // 8 as pos, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by pos)) end as h from w{i} group by pos // 8)",
            f"v{i} as (select x.pos, any_value(x.n) as n, coalesce(string_agg(y.h, '' order by y.pos) filter (y.pos < x.pos), '') as before, coalesce(string_agg(y.h, '' order by y.pos) filter (y.pos > x.pos), '') as after from w{i} x join w{i} y on x.pos // 8 = y.pos // 8 group by x.pos)",
        ]
    steps.append("f0 as (select row_number() over () as row, l.doc_id, l.leaf, l.lang, l.pos, b0.pos as lang_at, b0.subroot, l.back, '' as proof from l join b0 on l.lang is not distinct from b0.lang)")
    fold = "case when s.n > 1 then sha256(s.before || f.back || s.after) else f.back end as back, f.proof || s.before || s.after as proof"
    for i in range(levels):
        steps.append(f"f{i + 1} as (select f.row, f.doc_id, f.leaf, f.lang, f.pos // 8 as pos, f.lang_at, f.subroot, {fold} from f{i} f join s{i} s on {link('s', 'f')} and s.pos = f.pos)")
    for i in range(3):
        steps.append(f"f{levels + 1 + i} as (select f.row, f.doc_id, f.leaf, f.lang, f.pos, f.lang_at // 8 as lang_at, f.subroot, {fold} from f{levels + i} f join v{i} s on s.pos = f.lang_at)")
    return f"with {', '.join(steps)} select doc_id, leaf, subroot, (select h from u3) as root, sha256(proof) as proof_sha256, back as folded_root, back = (select h from u3) as verified from f{levels + 3}"


#: Token ids and counts, trained scores, packing and splitters are beyond SQL; tests/llm hold those against brute force. The nearest neighbours are those of an exact search, which these tables allow.
ORACLES: dict[str, str] = {"op2_jaccard": _JACCARD.strip(), "op3_chat": _CHAT.strip(), "op4_ann": _NEAREST.strip(), "op10_neardup": _VECTORS.strip(), "op12_divergence": _DIVERGENCE.strip(), "op13_manifest": _merkle()}
