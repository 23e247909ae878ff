"""Figures of aggregates as SVG files, without a plotting library: heat map, grouped bars, lines."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

#: Rows that a figure shows; a figure is drawn from aggregates.
MOST_ROWS = 10_000


def _rows(df: DataFrame, *columns: str) -> list[tuple]:
    rows = [tuple(r) for r in df.select(*columns).orderBy(*columns[:-1]).limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} marks; aggregate first")
    return rows


def _svg(width: float, height: float, title: str, body: list[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="11">'
    return "\n".join([head, f'<text x="10" y="16" font-size="13">{escape(title)}</text>', *body, "</svg>"])


def _label(x: float, y: float, text: object, anchor: str = "start") -> str:
    return f'<text x="{x:g}" y="{y:g}" text-anchor="{anchor}">{escape(str(text))}</text>'


def heatmap(df: DataFrame, row: str, column: str, value: str, title: str = "") -> str:
    """A cell for each (row, column), darker for larger values; missing cells stay white."""
    cells = {(r, c): v for r, c, v in _rows(df, row, column, value) if v is not None}
    rows, columns = sorted({r for r, _ in cells}, key=str), sorted({c for _, c in cells}, key=str)
    low, high = min(cells.values(), default=0), max(cells.values(), default=1)
    body = [_label(176, 50 + 24 * i, r, "end") for i, r in enumerate(rows)] + [_label(180 + 60 * j + 28, 32, c, "middle") for j, c in enumerate(columns)]
    for (r, c), v in sorted(cells.items(), key=str):
        share = (v - low) / (high - low) if high > low else 0.5
        x, y = 180 + 60 * columns.index(c), 36 + 24 * rows.index(r)
        body.append(f'<rect x="{x}" y="{y}" width="56" height="20" fill="hsl(210,60%,{95 - 60 * share:.1f}%)"/>')
        body.append(_label(x + 28, y + 14, f"{v:.3g}", "middle"))
    return _svg(200 + 60 * len(columns), 60 + 24 * len(rows), title, body)


def bars(df: DataFrame, name: str, group: str, value: str, title: str = "") -> str:
    """A bar for each (name, group), side by side by name."""
    marks = [m for m in _rows(df, name, group, value) if m[2] is not None]
    groups = sorted({g for _, g, _ in marks}, key=str)
    top = max((v for *_, v in marks), default=1) or 1
    body = []
    for i, (n, g, v) in enumerate(marks):
        body.append(f'<rect x="180" y="{30 + 16 * i}" width="{300 * max(0, v) / top:.1f}" height="12" fill="hsl({360 * groups.index(g) // max(1, len(groups))},50%,55%)"/>')
        body.append(_label(176, 40 + 16 * i, f"{n} {g}", "end") + _label(184 + 300 * max(0, v) / top, 40 + 16 * i, f"{v:.3g}"))
    return _svg(560, 50 + 16 * len(marks), title, body)


def lines(df: DataFrame, group: str, x: str, y: str, title: str = "") -> str:
    """A line for each group through its points in the order of x."""
    marks = [m for m in _rows(df, group, x, y) if None not in m[1:]]
    groups = sorted({g for g, *_ in marks}, key=str)
    xs, ys = [m[1] for m in marks] or [0], [m[2] for m in marks] or [0]
    place = lambda v, lo, hi, a, b: a + (b - a) * ((v - lo) / (hi - lo) if hi > lo else 0.5)
    body = []
    for i, g in enumerate(groups):
        points = " ".join(f"{place(a, min(xs), max(xs), 50, 450):.1f},{place(b, min(ys), max(ys), 250, 30):.1f}" for k, a, b in marks if k == g)
        colour = f"hsl({360 * i // max(1, len(groups))},50%,45%)"
        body.append(f'<polyline points="{points}" fill="none" stroke="{colour}" stroke-width="2"/>')
        body.append(f'<g fill="{colour}">{_label(460, 40 + 14 * i, g)}</g>')
    body += [_label(50, 268, f"{min(xs):g}"), _label(450, 268, f"{max(xs):g}", "end"), _label(46, 250, f"{min(ys):.3g}", "end"), _label(46, 34, f"{max(ys):.3g}", "end")]
    return _svg(600, 280, title, body)


def write_figure(svg: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(svg)
