"""DuckDB SQL of the repair of conversations: costs and audits forwards, row by row, in one recursive query."""

from __future__ import annotations


def _then(state: str, cost: str, letter: str, line: str = "''") -> str:
    """A state is nine digits of cost, the audit, a bar and the repaired lines, so the least string is the wanted one."""
    at = f"strpos({state}, '|')"
    return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10, {at} - 10) || '{letter}' || substr({state}, {at}) || {line})"


def _insertions(s: list[str]) -> list[str]:
    user = f"least({s[2]}, {', '.join(_then(s[q], '3', 'I', chr(39) + 'user:' + chr(39) + ' || chr(10)') for q in (0, 1, 3))})"
    return [s[0], s[1], user, f"least({s[3]}, {_then('u', '3', 'I', chr(39) + 'assistant:' + chr(39) + ' || chr(10)')})"]


def _step() -> str:
    """The four states after a row, from x0..x3 before it."""
    kept, user, assistant = "r.role || ':' || r.text || chr(10)", "'user:' || r.text || chr(10)", "'assistant:' || r.text || chr(10)"
    stays, late = "r.fault in (0, 3)", "(case when r.fault = 3 then 3 else 0 end)"

    def keep(q: int, initial: str) -> str:
        return f"case when {stays} and left(r.role, 1) = '{initial}' then {_then(f'x{q}', late, 'K', kept)} end"

    def rerole(q: int, line: str) -> str:
        return f"case when {stays} then {_then(f'x{q}', f'3 + {late}', 'R', line)} end"

    delete = [_then(f"x{q}", "4", "D") for q in range(4)]
    return ", ".join(
        [
            f"{delete[0]} as s0",
            f"least({delete[1]}, {keep(0, 's')}) as s1",
            f"least({delete[2]}, {', '.join(keep(q, 'u') for q in (0, 1, 3))}, {', '.join(rerole(q, user) for q in (0, 1, 3))}) as s2",
            f"least({delete[3]}, {keep(2, 'a')}, {rerole(2, assistant)}) as s3",
        ]
    )


_moved = _insertions(["s0", "s1", "s2", "s3"])
_closed = f"(select s0 as x0, s1 as x1, u as x2, {_moved[3].replace('s3', 'y.s3')} as x3, g, i from (select *, {_moved[2]} as u from w) y)"

SQL = f"""
with recursive crc as (
    select list(list_reduce([k] || range(8), lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by k) as t
    from (select unnest(range(256)) as k)
), dealt as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
           xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint),
               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 as kind
    from conversations, crc
), hurt as (
    select conv_id, turn, case when kind = 4 then 'user' else role end as role,
           case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
    from dealt, (select unnest([0, 1]) as twice) where kind <> 0 and (twice = 0 or kind = 3)
), named as (
    select dense_rank() over (order by conv_id nulls first) as g, conv_id from (select distinct conv_id from conversations)
), placed as (
    select g, turn, role, text, row_number() over (partition by g order by turn nulls first, role, text) as i
    from hurt join named on hurt.conv_id is not distinct from named.conv_id
), r as (
    select *, lag(left(role, 1)) over (partition by g order by i) as before,
           case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1
                when row_number() over (partition by g, role, text order by i) > 1 then 2
                when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 3 else 0 end as fault
    from placed
), w as (
    select g, 0::bigint as i, '000000000|' as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from named
    union all
    select c.g, r.i, {_step()} from {_closed} c join r on r.g = c.g and r.i = c.i + 1
), ended as (
    select g, least(x0, x3) as s from {_closed} c where i = (select count(*) from r where r.g = c.g)
), found as (
    select g, left(s, 9)::bigint as cost, substr(s, 10, strpos(s, '|') - 10) as audit, substr(s, strpos(s, '|') + 1) as lines from ended
), counted as (
    select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count_if(fault = 1)::bigint as blank, count_if(fault = 2)::bigint as duplicate,
           count_if(fault = 3)::bigint as truncated, count_if(i > 1 and before || left(role, 1) not in ('su', 'ua', 'au'))::bigint as illegal
    from r group by g
)
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cost, audit, sha256(left(lines, greatest(length(lines) - 1, 0))) as repaired_sha256
from named join found using (g) left join counted using (g)
"""
