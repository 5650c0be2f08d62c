"""A plain version of tables from OCR boxes, a page at a time, to compare with."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tabulon.sources import fixed_values as fixed
from tabulon.sources.config import norm


@dataclass
class Cell:
    x: float
    y: float
    text: str


@dataclass
class Column:
    centre: float
    members: list[int] = field(default_factory=list)
    name: str = ""


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _rows(cells: list[Cell], tolerance: float) -> list[list[Cell]]:
    rows: list[list[Cell]] = []
    for c in sorted(cells, key=lambda c: c.y):
        if rows and abs(c.y - _mean([d.y for d in rows[-1]])) <= tolerance:
            rows[-1].append(c)
        else:
            rows.append([c])
    return rows


def _tokens(texts: list[str]) -> int:
    return sum(norm(t) in fixed.OCR_HEADER_TOKENS for t in texts)


def _header_row(rows: list[list[Cell]]) -> int | None:
    """The row with the most header tokens, at least two; where item numbers begin shortly below
    another such row, the nearest one above them."""
    counts = [_tokens([c.text for c in r]) for r in rows]
    best = max(range(len(rows)), key=lambda i: (counts[i], -i))
    if counts[best] < 2:
        return None
    numbered = [i for i, r in enumerate(rows) if any(re.match(fixed.ITEM_NO_PATTERN, c.text) for c in r)]
    onset = next((a for a, b in zip(numbered, numbered[1:]) if b - a <= 3), 0)
    return next((i for i in range(onset - 1, max(onset - 6, -1), -1) if counts[i] >= 2), best)


def _single_link(xs: list[float], gap: float) -> list[float]:
    groups: list[list[float]] = []
    for x in sorted(xs):
        if groups and x - groups[-1][-1] <= gap:
            groups[-1].append(x)
        else:
            groups.append([x])
    return [_mean(g) for g in groups]


def _nearest(x: float, columns: list[Column]) -> int:
    return min(range(len(columns)), key=lambda i: abs(columns[i].centre - x))


def _row_texts(row: list[Cell], centres: list[Column]) -> dict[int, str]:
    out: dict[int, str] = {}
    for c in sorted(row, key=lambda c: c.x):
        i = _nearest(c.x, centres)
        out[i] = f"{out[i]} {c.text}" if i in out else c.text
    return out


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for i, n in enumerate(names):
        n = n or f"col{i}"
        seen[n] = seen.get(n, -1) + 1
        out.append(f"{n}_{seen[n]}" if seen[n] else n)
    return out


def _merge_stopwords(groups: list[Column]) -> list[Column]:
    """A header that is a stop word joins its neighbours: both, if both are words of their own, else
    the one to the left, else the one to the right."""
    is_stop = lambda g: g.name.lower() in fixed.OCR_STOPWORDS
    solid = lambda g: len(g.name) > 3 and not is_stop(g)
    i = 0
    while i < len(groups):
        if not is_stop(groups[i]) or len(groups) == 1:
            i += 1
            continue
        both = 0 < i < len(groups) - 1 and solid(groups[i - 1]) and solid(groups[i + 1])
        lo, hi = (i - 1, i + 2) if both else (i - 1, i + 1) if i else (0, 2)
        some = groups[lo:hi]
        groups[lo:hi] = [Column(some[0].centre, [m for g in some for m in g.members], " ".join(g.name for g in some))]
        i = lo + 1 if both or i else 0
    return groups


def _extract(rows: list[list[Cell]], header_y: float, centres: list[Column], groups: list[Column], limit: float) -> list[list[str]]:
    """Records of rows that lead away from the header, up to the first large gap."""
    out, at = [], header_y
    for row in rows:
        y = _mean([c.y for c in row])
        if abs(y - at) > limit:
            break
        at = y
        found = _row_texts(row, centres)
        cells = [" ".join(found[m] for m in g.members if m in found) for g in groups]
        filled = [c.lower() for c in cells if c]
        if filled and _tokens(filled) < 3 and not any(c.startswith(tuple(fixed.OCR_SKIP_PREFIXES)) for c in filled):
            out.append(cells)
    return out


def table_of(boxes: list[tuple], page_w: float) -> tuple[list[str], list[list[str]]]:
    """Names and records from (box points, text, score). Columns come from the header's cells, and
    from at least two cells below that are farther than a column gap from all of those."""
    cells, heights = [], []
    for points, text, score in boxes:
        text = (text or "").strip()
        if text and (score is None or score >= fixed.OCR_MIN_SCORE):
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            cells.append(Cell(_mean(xs), _mean(ys), text))
            heights.append(max(ys) - min(ys))
    if len(cells) < 4:
        return [], []
    height = sorted(heights)[len(heights) // 2] or 12
    rows = _rows(cells, max(8.0, 0.7 * height))
    top = _header_row(rows)
    if top is None or top == len(rows) - 1:
        return [], []
    gap, limit = max(40.0, 0.035 * page_w), 5.0 * height
    centres = [Column(x) for x in _single_link([c.x for c in rows[top]], gap)]
    stray = [c.x for r in rows[top + 1 :] for c in r if all(abs(c.x - k.centre) > gap for k in centres)]
    extra = [x for x in _single_link(stray, gap) if sum(abs(s - x) <= gap for s in stray) >= 2]
    centres = sorted(centres + [Column(x) for x in extra], key=lambda c: c.centre)
    header = _row_texts(rows[top], centres)
    names = _unique([header.get(i, "") for i in range(len(centres))])
    groups = _merge_stopwords([Column(c.centre, [i], n) for i, (c, n) in enumerate(zip(centres, names))])
    names = _unique([g.name for g in groups])
    header_y = _mean([c.y for c in rows[top]])
    records = _extract(rows[top + 1 :], header_y, centres, groups, limit)
    number = next((i for i, n in enumerate(names) if norm(n) in fixed.OCR_NUMBER_TOKENS), None)
    if number is not None and records and top:
        share = lambda rs: sum(r[number].isdigit() for r in rs) / len(rs)
        if share(records) < 0.3:  # perhaps the table stands on its header
            lo, hi = centres[0].centre - 2 * gap, centres[-1].centre + 2 * gap
            above = [[c for c in r if lo <= c.x <= hi] for r in reversed(rows[:top])]
            other = _extract([r for r in above if r], header_y, centres, groups, limit)
            if other and share(other) > share(records):
                records = other
    return _rescue(names, records), records


def _rescue(names: list[str], records: list[list[str]]) -> list[str]:
    """The most textual unnamed column becomes Description, unless one has a like name."""
    if any(k in n.lower() for n in names for k in fixed.NAME_LIKE):
        return names
    best, most = None, 0.0
    for i, n in enumerate(names):
        filled = [r[i] for r in records if r[i]]
        if re.fullmatch(r"col\d+", n) and filled:
            texty, size = sum(bool(re.search("[A-Za-z]", v)) for v in filled) / len(filled), _mean([len(v) for v in filled])
            if texty >= 0.6 and size >= 4 and texty * size > most:
                best, most = i, texty * size
    return [("Description" if i == best else n) for i, n in enumerate(names)]
