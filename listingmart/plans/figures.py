"""Figures as SVG texts, drawn from small collected aggregates: bars, boxes, points and a matrix.

One hue carries magnitudes; a diverging pair with a neutral middle carries correlations. Each mark names its value
in a tooltip, and the table that a figure is drawn from is saved beside it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from html import escape

SURFACE, INK, SOFT, GRID, HUE = "#fcfcfb", "#0b0b0b", "#52514e", "#e1e0d9", "#2a78d6"
LOW, MIDDLE, HIGH = (0xE3, 0x49, 0x48), (0xF0, 0xEF, 0xEC), (0x2A, 0x78, 0xD6)
MIDDLE_HEX = "#f0efec"
WIDTH, HEIGHT, LEFT, BOTTOM, TOP = 560, 340, 70, 44, 40


def short(x: float) -> str:
    return f"{x:,.0f}" if abs(x) >= 100 or x == int(x) else f"{x:.3g}"


def text(x: float, y: float, body: str, anchor: str = "middle", color: str = SOFT, size: int = 11) -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" fill="{color}" font-size="{size}">{escape(body)}</text>'


def ticks(most: float) -> list[float]:
    """Round numbers from 0 on, about five, up to the first that is not below the greatest value."""
    raw = (most if most > 0 else 1.0) / 5
    base = 10.0 ** math.floor(math.log10(raw))
    step = next(m * base for m in (1, 2, 5, 10) if m * base >= raw * (1 - 1e-9))
    return [k * step for k in range(math.ceil(most / step - 1e-9) + 1)] if most > 0 else [0.0, 1.0]


class Panel:
    """A titled frame with a scale from 0 to the last tick on one or both axes."""

    def __init__(self, title: str, x_name: str = "", y_name: str = ""):
        self.parts = [text(LEFT, 20, title, "start", INK, 13), text((LEFT + WIDTH) / 2, HEIGHT - 6, x_name), text(8, 34, y_name, "start")]

    def y_axis(self, most: float) -> Callable[[float], float]:
        marks = ticks(most)
        place = lambda v: HEIGHT - BOTTOM - (HEIGHT - BOTTOM - TOP) * min(max(v, 0), marks[-1]) / marks[-1]
        for v in marks:
            self.parts.append(f'<line x1="{LEFT}" x2="{WIDTH - 10}" y1="{place(v):.1f}" y2="{place(v):.1f}" stroke="{GRID}"/>')
            self.parts.append(text(LEFT - 6, place(v) + 4, short(v), "end"))
        return place

    def x_axis(self, most: float) -> Callable[[float], float]:
        marks = ticks(most)
        place = lambda v: LEFT + (WIDTH - 10 - LEFT) * min(max(v, 0), marks[-1]) / marks[-1]
        self.parts += [text(place(v), HEIGHT - BOTTOM + 16, short(v)) for v in marks]
        return place

    def box(self, x: float, y: float, w: float, h: float, said: str, fill: str = HUE) -> None:
        self.parts.append(
            f'<rect x="{x:.1f}" y="{y:.1f}" width="{max(w, 0.5):.1f}" height="{max(h, 0):.1f}" fill="{fill}"><title>{escape(said)}</title></rect>'
        )


def histogram(title: str, rows: Sequence[dict], name: str) -> Panel:
    """rows: low, high, n."""
    p = Panel(title, name, "listings")
    if rows:
        least, most = min(r["low"] for r in rows), max(r["high"] for r in rows)
        y, span, wide = p.y_axis(max(r["n"] for r in rows)), (most - least) or 1.0, WIDTH - 10 - LEFT
        for r in rows:
            x = LEFT + wide * (r["low"] - least) / span
            p.box(
                x, y(r["n"]), wide * (r["high"] - r["low"]) / span - 1, y(0) - y(r["n"]), f"{short(r['low'])} to {short(r['high'])}: {short(r['n'])}"
            )
        p.parts += [text(LEFT + wide * k / 4, HEIGHT - BOTTOM + 16, short(least + span * k / 4)) for k in range(5)]
    return p


def bars(title: str, rows: Sequence[tuple[str, float]], name: str) -> Panel:
    """Horizontal bars with their values."""
    p = Panel(title, name)
    if rows:
        most, high = max(v for _, v in rows) or 1.0, (HEIGHT - BOTTOM - TOP) / len(rows)
        for k, (label, v) in enumerate(rows):
            y, long = TOP + k * high, (WIDTH - 200) * v / most
            p.box(130, y + 1, long, min(high - 2, 18), f"{label}: {short(v)}")
            p.parts += [text(124, y + high / 2 + 3, label, "end"), text(136 + long, y + high / 2 + 3, short(v), "start")]
    return p


def boxes(title: str, rows: Sequence[dict], key: str, most: float) -> Panel:
    """rows: q1, median, q3, min, max by key; whiskers of 1.5 times the quartiles' distance, cut at the scale's end."""
    p = Panel(title, key, "price")
    if rows:
        y, wide = p.y_axis(most), (WIDTH - 10 - LEFT) / len(rows)
        for k, r in enumerate(rows):
            middle, reach = LEFT + wide * (k + 0.5), 1.5 * (r["q3"] - r["q1"])
            ends = max(r["min"], r["q1"] - reach), min(r["max"], r["q3"] + reach)
            said = f"{key} {r[key]}: {short(r['q1'])}, {short(r['median'])}, {short(r['q3'])}"
            p.parts.append(f'<line x1="{middle:.1f}" x2="{middle:.1f}" y1="{y(ends[0]):.1f}" y2="{y(ends[1]):.1f}" stroke="{SOFT}"/>')
            p.box(middle - wide * 0.3, y(r["q3"]), wide * 0.6, y(r["q1"]) - y(r["q3"]), said)
            p.parts.append(
                f'<line x1="{middle - wide * 0.3:.1f}" x2="{middle + wide * 0.3:.1f}" y1="{y(r["median"]):.1f}" y2="{y(r["median"]):.1f}" '
                f'stroke="{SURFACE}" stroke-width="2"/>'
            )
            p.parts.append(text(middle, HEIGHT - BOTTOM + 16, str(r[key])))
    return p


def points(title: str, rows: Sequence[dict], x_name: str, y_name: str) -> Panel:
    p = Panel(title, x_name, y_name)
    rows = [r for r in rows if r[x_name] is not None and r[y_name] is not None]
    if rows:
        x, y = p.x_axis(max(r[x_name] for r in rows)), p.y_axis(max(r[y_name] for r in rows))
        p.parts += [f'<circle cx="{x(r[x_name]):.1f}" cy="{y(r[y_name]):.1f}" r="2" fill="{HUE}" fill-opacity="0.25"/>' for r in rows]
    return p


def tint(v: float) -> str:
    end = HIGH if v > 0 else LOW
    return "#" + "".join(f"{round(a + (b - a) * min(abs(v), 1)):02x}" for a, b in zip(MIDDLE, end, strict=True))


def matrix(title: str, rows: Sequence[dict]) -> Panel:
    """rows: variable_1, variable_2, corr."""
    p, names = Panel(title), list(dict.fromkeys(r["variable_1"] for r in rows))
    wide, high = (WIDTH - 140) / max(1, len(names)), (HEIGHT - 70 - TOP) / max(1, len(names))
    for r in rows:
        i, j = names.index(r["variable_1"]), names.index(r["variable_2"])
        value = r["corr"]
        p.box(
            130 + j * wide, TOP + i * high, wide - 2, high - 2, f"{names[i]}, {names[j]}: {'unknown' if value is None else f'{value:.3f}'}",
            MIDDLE_HEX if value is None else tint(value)
        )
        strong = value is not None and abs(value) > 0.75
        p.parts.append(
            text(130 + (j + 0.5) * wide - 1, TOP + (i + 0.5) * high + 3, "" if value is None else f"{value:.2f}", color=SURFACE if strong else INK)
        )
    for k, name in enumerate(names):
        p.parts += [text(124, TOP + (k + 0.5) * high + 3, name, "end"), text(130 + (k + 0.5) * wide, HEIGHT - 52 + 12 * (k % 3), name, size=9)]
    return p


def page(panels: Sequence[Panel], columns: int = 2) -> str:
    """Panels side by side as one SVG document."""
    rows = -(-len(panels) // columns)
    size = f'width="{WIDTH * min(columns, len(panels))}" height="{HEIGHT * rows}"'
    body = "".join(
        f'<g transform="translate({WIDTH * (k % columns)},{HEIGHT * (k // columns)})">{"".join(p.parts)}</g>' for k, p in enumerate(panels)
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" {size} font-family="sans-serif"><rect width="100%" height="100%" fill="{SURFACE}"/>{body}</svg>'
