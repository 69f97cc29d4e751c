"""DuckDB SQL for the operators that SQL can express: the license scan and quotation linking."""

from __future__ import annotations

from palimpsest.llm import licenses

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _normal(x: str) -> str:
    return f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BETWEEN}', ' ', 'g'))"


def license_scan() -> str:
    places, base = [], []
    for phrase, label in licenses.PHRASES.items():
        words = phrase.split()
        same = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        places.append(f"list_filter(range(1, len(w) - {len(words)} + 2), lambda i: {same})")
        base.append(label)
    common = []
    for k, _, unit, tokens, _ in licenses.templates():
        listed = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
        common.append(f"list_max(list_transform({unit}s, lambda b: len(list_intersect(list_distinct(string_split({_normal('b')}, ' ')), {listed})))) c{k}")
    met = [f"case when c{k} >= {need} then '{label}' end" for k, label, _, _, need in licenses.templates()]
    best = [f"case when c{k} >= {need} then c{k} / {len(tokens)}.0 else 0 end" for k, _, _, tokens, need in licenses.templates()]
    based = [f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(base)]
    joined = lambda xs: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{', '.join(xs)}], lambda x: x is not null))), ','), '')"
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
m as (select doc_id, t, {_normal('t')} norm, string_split_regex(t, '\\n[ \\t\\r]*\\n') paragraphs from d),
n as (select *, flatten(list_transform(list_transform(paragraphs, lambda p: string_split(p, chr(10))), lambda x: list_transform(range(1, greatest(len(x) - {licenses.LINES - 1}, 1) + 1), lambda i: array_to_string(x[i : i + {licenses.LINES - 1}], ' ')))) windows from m),
s as (select *, case when norm = '' then [] else string_split(norm, ' ') end w from n),
p as (select *, {', '.join(f'{x} p{k}' for k, x in enumerate(places))} from s),
c as (select *, {', '.join(common)} from p),
a as (select *, list_concat({', '.join(f'p{k}' for k in range(len(places)))}) places from c)
select doc_id, cast(len(w) as bigint) n_words, cast(len(places) as bigint) n_base, cast(list_min(places) - 1 as bigint) first_word, cast(list_max(places) - 1 as bigint) last_word,
  {joined(based)} base_labels, {joined(based + met)} labels,
  cast(case when len(places) > 0 then 1.0 else greatest({', '.join(best)}) end as double) score
from a"""


def quotation_linking(least: int = 8) -> str:
    parts = lambda x: f"list_concat(string_split_regex({x}, '\\n[ \\t]*\\n'), flatten(list_transform(string_split_regex({x}, '\\n[ \\t]*\\n'), lambda p: string_split_regex(p, '[.!?]+[ \\t\\n]+'))), string_split({x}, chr(10)))"
    whole = lambda x: f"case when length({_normal(x)}) < {least} then '=' || {_normal(x)} else {_normal(x)} end"
    mark, attribution = r"^[ \t]*(>[> \t]*)", r"(?i)^[ \t]*(on .* wrote|le .* a écrit|am .* schrieb|el .* escribió)[ \t]*:[ \t]*$"
    return f"""
with recursive m as (select row_number() over () rid, conv_id, cast(turn as bigint) turn, role, text, string_split(replace(coalesce(text, ''), chr(13), ''), chr(10)) lines from conversations),
x as (select rid, unnest(range(1, len(lines) + 1)) pos from m),
l as (select m.rid, conv_id, turn, pos, lines[pos] raw, regexp_extract(lines[pos], '{mark}', 1) mark from m join x on m.rid = x.rid),
k as (select rid, conv_id, turn, pos, len(mark) - len(replace(mark, '>', '')) lvl, case when mark = '' then raw else regexp_replace(raw, '{mark}', '') end line from l),
q as (select *, pos - row_number() over (partition by rid, lvl order by pos) run from k where lvl > 0),
quoting as (select rid, max(lvl) max_level, count(distinct lvl || '/' || run) n from q group by rid),
passages as (select conv_id, turn, lvl, string_agg(line, chr(10) order by pos) t from q group by rid, conv_id, turn, lvl, run),
pieces as (select conv_id, turn, lvl, unnest({parts('t')}) x from passages),
units as (select conv_id, turn, lvl, {whole('t')} u from passages where {_normal('t')} <> '' union select conv_id, turn, lvl, {_normal('x')} from pieces where length({_normal('x')}) >= {least}),
quoted as (select conv_id, turn, u, min(lvl) lvl, length(u) size from units where conv_id is not null and turn is not null group by conv_id, turn, u),
own as (select k.* from k left join quoting on k.rid = quoting.rid where lvl = 0 and not (n is not null and regexp_matches(line, '{attribution}'))),
wrote as (select conv_id, turn, string_agg(line, chr(10) order by pos) t from own group by rid, conv_id, turn),
bits as (select conv_id, turn, unnest({parts('t')}) x from wrote),
mine as (select conv_id, turn, {whole('t')} u from wrote where {_normal('t')} <> '' union select conv_id, turn, {_normal('x')} from bits where length({_normal('x')}) >= {least}),
first as (select conv_id, u, min(turn) t from mine group by conv_id, u),
links as (select quoted.conv_id, quoted.turn, t parent_turn, row_number() over (partition by quoted.conv_id, quoted.turn order by lvl, size desc, t desc) r from quoted join first on quoted.conv_id = first.conv_id and quoted.u = first.u where t < quoted.turn),
parents as (select conv_id, turn, parent_turn from links where r = 1),
up as (select conv_id, turn, parent_turn anc, cast(1 as bigint) depth from parents union all select up.conv_id, up.turn, p.parent_turn, depth + 1 from up join parents p on p.conv_id = up.conv_id and p.turn = up.anc),
roots as (select conv_id, turn, min(anc) root_turn, max(depth) depth from up group by conv_id, turn),
bodies as (select rid, trim(string_agg(line, chr(10) order by pos)) body from own group by rid)
select m.conv_id, m.turn, m.role, case when contains(coalesce(m.text, ''), '>') then coalesce(bodies.body, '') else replace(coalesce(m.text, ''), chr(13), '') end body,
  cast(coalesce(quoting.n, 0) as bigint) n_passages, cast(coalesce(max_level, 0) as bigint) max_level, parents.parent_turn, coalesce(root_turn, m.turn) root_turn, coalesce(depth, 0) depth
from m left join quoting on m.rid = quoting.rid left join bodies on m.rid = bodies.rid
left join parents on m.conv_id = parents.conv_id and m.turn = parents.turn left join roots on m.conv_id = roots.conv_id and m.turn = roots.turn"""
