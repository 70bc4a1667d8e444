"""Checking SQL of the conversation repair and the Merkle manifest, built from small parts."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    octets = f"list_transform(string_split({text}, ''), lambda c: cast(ord(c) as bigint))"
    step = "lambda x, i: xor(x // 2, (x % 2) * 3988292384)"
    byte = f"list_reduce(list_prepend(xor(a, b), cast(range(8) as bigint[])), {step})"
    folded = f"list_reduce(list_prepend(4294967295, {octets}), lambda a, b: {byte})"
    return f"xor(4294967295, {folded})"


# ---- Merkle manifest ----------------------------------------------------------------


def _levels(name: str, start: str, levels: int) -> str:
    """CTEs name0, name1, ...: nodes (tree, pos, h, n) with the others of their run (l, r)."""
    others = (
        "coalesce(string_agg(h, '') over (partition by tree, pos // 8 order by pos "
        "rows between unbounded preceding and 1 preceding), '') l, "
        "coalesce(string_agg(h, '') over (partition by tree, pos // 8 order by pos "
        "rows between 1 following and unbounded following), '') r"
    )
    out = [f"{name}0 as (select *, {others} from {start})"]
    for k in range(1, levels + 1):
        up = (
            "select tree, pos // 8 pos, sha256(string_agg(h, '' order by pos)) h, "
            f"max((n + 7) // 8) n from {name}{k - 1} where n > 1 group by 1, 2"
        )
        out.append(f"{name}{k} as (select *, {others} from ({up}))")
    return ",\n".join(out)


def _climb(name: str, levels: int, start: str) -> tuple[str, str, str]:
    """Joins of a leaf ``x`` with its nodes, its siblings' text, and the root from ``start``."""
    joins, proof, root = [], [], start
    for k in range(levels + 1):
        joins.append(f"left join {name}{k} {name}_{k} on {name}_{k}.tree = x.{name}_tree "
                     f"and {name}_{k}.n > 1 and {name}_{k}.pos = x.{name}_pos // {8**k}")
        proof.append(f"coalesce({name}_{k}.l || {name}_{k}.r, '')")
        root = (f"case when {name}_{k}.n is null then {root} "
                f"else sha256({name}_{k}.l || {root} || {name}_{k}.r) end")
    return "\n".join(joins), " || ".join(proof), root


def merkle_sql(levels: int = 6, group_levels: int = 3) -> str:
    """Trees of up to 8^levels leaves each, under 8^group_levels groups."""
    field = lambda c: (
        f"coalesce(cast(strlen(cast({c} as varchar)) as varchar) || ':' || {c}, '-')"
    )
    leaf = lambda text: "sha256(" + " || ".join(
        field(c) for c in ("doc_id", "source", "lang", "n_chars", text)
    ) + ")"
    lowered = ("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    roots = " union all ".join(f"select tree, h from a{k} where n = 1" for k in range(levels + 1))
    top = " union all ".join(f"select h from b{k} where n = 1" for k in range(group_levels + 1))
    below, proof_a, fold_a = _climb("a", levels, "x.start")
    above, proof_b, fold_b = _climb("b", group_levels, "y.folded_a")
    above = above.replace("x.", "y.")
    return f"""
        with leaves as (
          select doc_id, coalesce('=' || lang, '') tree, {leaf('text')} h,
                 case when {crc32_sql('cast(doc_id as varchar)')} % 3 = 0
                      then {leaf(f'({lowered})')} end other from documents),
        a as (select *, row_number() over (partition by tree order by doc_id nulls first, h) - 1 pos,
                     count(*) over (partition by tree) n from leaves),
        {_levels('a', 'a', levels)},
        subroots as ({roots}),
        b as (select tree grp, '' tree, h, row_number() over (order by tree) - 1 pos,
                     count(*) over () n from subroots),
        {_levels('b', 'b', group_levels)},
        top as ({top}),
        x as (select doc_id, h leaf, coalesce(other, h) as start, tree a_tree, pos a_pos from a),
        y as (select x.doc_id, x.leaf, x.a_tree, b.h subroot, {proof_a} proof_a,
                     {fold_a} folded_a, b.tree b_tree, b.pos b_pos
              from x join b on b.grp = x.a_tree {below}),
        z as (select y.*, sha256(proof_a || {proof_b}) proof_sha256, {fold_b} folded_root
              from y {above})
        select doc_id, leaf, subroot, (select h from top) root, proof_sha256, folded_root,
               folded_root = (select h from top) verified from z"""


# ---- conversation repair ------------------------------------------------------------


def _edit(state: str, cost: str, letter: str) -> str:
    """A state's text (eight digits of cost, then the audit) after one more edit."""
    return (f"lpad(cast(cast(substr({state}, 1, 8) as int) + {cost} as varchar), 8, '0') "
            f"|| substr({state}, 9) || '{letter}'")


def _row_step() -> str:
    """All four states behind a row from those before it: the least text is the cheapest."""
    initial, fault = "b[1][1]", "b[1][2]"
    extra = f"(case when {fault} = '3' then 3 else 0 end)"
    open_ = f"{fault} in ('0', '3')"

    def stay(source: int, letter: str) -> str:
        keep = f"{open_} and {initial} = '{letter}'"
        new = f"least({_edit(f'a[{source}]', extra, 'K')}, {_edit(f'a[{source}]', f'3 + {extra}', 'R')})"
        only = _edit(f"a[{source}]", f"3 + {extra}", "R")
        return f"(case when {keep} then {new} when {open_} then {only} end)"

    gone = [_edit(f"a[{q}]", "4", "D") for q in (1, 2, 3, 4)]
    system = (f"least({gone[1]}, case when {open_} and {initial} = 's' "
              f"then {_edit('a[1]', extra, 'K')} end)")
    user = f"least({gone[2]}, {stay(1, 'u')}, {stay(2, 'u')}, {stay(4, 'u')})"
    assistant = f"least({gone[3]}, {stay(3, 'a')})"
    row = f"[{gone[0]}, {system}, {user}, {assistant}]"
    added_user = f"least(s[3], {_edit('s[1]', '3', 'I')}, {_edit('s[2]', '3', 'I')}, {_edit('s[4]', '3', 'I')})"
    with_user = f"list_transform([{row}], lambda s: [s[1], s[2], {added_user}, s[4]])[1]"
    added = f"[t[1], t[2], t[3], least(t[4], {_edit('t[3]', '3', 'I')})]"
    return f"list_transform([{with_user}], lambda t: {added})[1]"


def repair_sql() -> str:
    visible = r"'[^\x20\x09-\x0D]'"
    ended = r"'[.!?][\x20\x09-\x0D]*$'"
    start = "['00000000', null, '00000003I', '00000006II']"
    kind = crc32_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || "
                     "coalesce(cast(turn as varchar), ' ')")
    return f"""
        with damaged as (
          select conv_id, turn, kind, case when kind = 4 then 'user' else coalesce(role, ' ') end role,
                 case when kind = 1 then '' when kind = 2
                      then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
                      else coalesce(text, ' ') end text
          from (select *, {kind} % 20 kind from conversations)),
        rows as (
          select *, coalesce(cast(conv_id as varchar), ' ') c, row_number() over (
                 partition by conv_id order by turn nulls first,
                 sha256(cast(strlen(role) as varchar) || ':' || role || text)) i
          from damaged, unnest(range(case when kind = 3 then 2 else 1 end)) u(copy)
          where kind <> 0),
        told as (
          select *, case when not regexp_matches(text, {visible}) then 1
                         when row_number() over (partition by c, role, text order by i) > 1 then 2
                         when not regexp_matches(text, {ended}) then 3 else 0 end fault,
                 lag(role[1]) over (partition by c order by i) || role[1]
                   not in ('su', 'ua', 'au') bad
          from rows),
        sums as (
          select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps,
                 count(*) filter (fault = 1) blank, count(*) filter (fault = 2) duplicate,
                 count(*) filter (fault = 3) truncated, count(*) filter (bad) illegal,
                 list([case when role[1] = '' then ' ' else role[1] end || cast(fault as varchar)]
                      order by i) codes
          from told group by 1),
        solved as (
          select *, list_reduce(list_prepend({start}, codes), lambda a, b: {_row_step()}) f from sums),
        cheap as (select *, least(f[1], f[4]) best from solved),
        letters as (
          select c, k, substr(best, 8 + cast(k as int), 1) letter,
                 count(*) filter (substr(best, 8 + cast(k as int), 1) <> 'I')
                   over (partition by c order by k) i
          from cheap, unnest(range(1, length(best) - 7)) u(k)),
        emitted as (
          select l.c, k, letter, role, text, row_number() over (partition by l.c order by k) j
          from letters l left join told t on t.c = l.c and t.i = l.i where letter <> 'D'),
        placed as (
          select *, max(case when j = 1 and letter = 'K' and role[1] = 's' then 1 else 0 end)
                    over (partition by c) s from emitted),
        texts as (
          select c, string_agg(case when letter = 'K' then role
                                    when (j - s) % 2 = 1 then 'user' else 'assistant' end
                               || ':' || case when letter = 'I' then '' else text end,
                               chr(10) order by k) text from placed group by 1)
        select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank,
               coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
               coalesce(illegal, 0) illegal,
               coalesce(cast(substr(best, 1, 8) as bigint), 0) "cost",
               coalesce(substr(best, 9), '') audit,
               sha256(coalesce(text, '')) repaired_sha256
        from (select distinct conv_id, coalesce(cast(conv_id as varchar), ' ') c
              from conversations) o
        left join cheap using (c) left join texts using (c)"""
