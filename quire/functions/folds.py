"""Greedy folds with reset, as higher-order expressions over one document's array, given as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_ids(lengths: str, most: int) -> Column:
    """Chunk of each element: a new one when the running length would pass most and is not zero."""
    return F.expr(
        f"aggregate({lengths}, named_struct('n', 0, 'len', 0L, 'ids', cast(array() as array<int>)), (a, x) -> "
        f"if(a.len + x > {most} and a.len > 0, named_struct('n', a.n + 1, 'len', cast(x as bigint), 'ids', array_append(a.ids, a.n + 1)), "
        f"named_struct('n', a.n, 'len', a.len + x, 'ids', array_append(a.ids, a.n))), a -> a.ids)"
    )


def overlapping_groups(sizes: str, most: int, overlap: int) -> Column:
    """Runs (first, behind the last) of elements: each as long as fits most, one element at least, the next going
    back by overlap but always forward by one."""
    s = sizes
    end = f"aggregate(slice({s}, a.at + 1, size({s})), named_struct('sum', 0L, 'n', 0, 'full', false), (b, x) -> if(b.full or (b.sum + x > {most} and b.n > 0), named_struct('sum', b.sum, 'n', b.n, 'full', true), named_struct('sum', b.sum + x, 'n', b.n + 1, 'full', false)), b -> a.at + b.n)"
    return F.expr(
        f"aggregate(sequence(1, greatest(size({s}), 1)), named_struct('at', 0, 'runs', cast(array() as array<struct<lo: int, hi: int>>)), (a, i) -> "
        f"if(a.at >= size({s}), a, transform(array({end}), e -> named_struct('at', if(e >= size({s}), size({s}), greatest(e - {overlap}, a.at + 1)), 'runs', array_append(a.runs, named_struct('lo', a.at, 'hi', e))))[0]), a -> a.runs)"
    )


def split_text(text: str, most: int) -> Column:
    """Pieces of about most characters: cut behind the last blank line in the second half of a piece, else behind
    its last line break there, else at most."""
    t = text
    half = f"(a.at + ({most} div 2))"
    blank = f"substring({t}, {half} + 1, {most} - ({most} div 2) + 1)"
    line = f"substring({t}, {half} + 1, {most} - ({most} div 2))"
    cut = (
        f"case when instr(reverse({blank}), '\\n\\n') > 0 then {half} + length({blank}) - instr(reverse({blank}), '\\n\\n') + 1 "
        f"when instr(reverse({line}), '\\n') > 0 then {half} + length({line}) - instr(reverse({line}), '\\n') + 1 else a.at + {most} end"
    )
    return F.expr(
        f"aggregate(sequence(0, 2 * length({t}) div {most} + 1), named_struct('at', 0, 'parts', cast(array() as array<string>)), (a, i) -> "
        f"if(a.at >= length({t}), a, if(a.at + {most} >= length({t}), named_struct('at', length({t}), 'parts', array_append(a.parts, substring({t}, a.at + 1, length({t})))), "
        f"transform(array(cast({cut} as int)), e -> named_struct('at', e, 'parts', array_append(a.parts, substring({t}, a.at + 1, e - a.at))))[0])), a -> a.parts)"
    )


def packed_paragraphs(text: str, page: int = 1500) -> Column:
    """Pages of a markdown text: paragraphs packed up to page characters, or cut at a heading beyond a third of it."""
    t = text
    parts = f"split({t}, '\\n{{2,}}', -1)"
    full = f"(length(a.cur) > 0 and length(a.cur) + length(p) > {page}) or (startswith(regexp_replace(p, '^\\\\s+', ''), '#') and length(a.cur) > {page // 3})"
    return F.expr(
        f"aggregate({parts}, named_struct('cur', '', 'pages', cast(array() as array<string>)), (a, p) -> "
        f"if({full}, named_struct('cur', p, 'pages', array_append(a.pages, a.cur)), named_struct('cur', if(length(a.cur) > 0, concat(a.cur, '\\n\\n', p), p), 'pages', a.pages)), "
        f"a -> if(length(a.cur) > 0, array_append(a.pages, a.cur), if(size(a.pages) = 0, array({t}), a.pages)))"
    )
