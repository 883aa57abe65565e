"""Recursive text chunking of one text (used inside a pandas UDF)."""

from __future__ import annotations

# Separators from coarse to fine; the empty one means single characters.
SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")


def _pieces(text: str, start: int, end: int, sep: str) -> list[tuple[int, int]]:
    """Cut [start, end) in front of every separator; the pieces cover the span."""
    if sep == "":
        return [(i, i + 1) for i in range(start, end)]
    cuts = [start]
    at = text.find(sep, start, end)
    while at != -1:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(sep, at + len(sep), end)
    cuts.append(end)
    return list(zip(cuts, cuts[1:]))


def _pack(text: str, pieces: list[tuple[int, int]], size: int, overlap: int) -> list[str]:
    """Join adjacent pieces to chunks of at most ``size``, sharing up to ``overlap``."""
    out: list[str] = []
    first = 0
    for i, (begin, end) in enumerate(pieces):
        if end - pieces[first][0] > size and first < i:
            chunk = text[pieces[first][0] : begin].strip()
            if chunk:
                out.append(chunk)
            while first < i and (
                begin - pieces[first][0] > overlap or end - pieces[first][0] > size
            ):
                first += 1
    if pieces:
        chunk = text[pieces[first][0] : pieces[-1][1]].strip()
        if chunk:
            out.append(chunk)
    return out


def chunk_text(text: str, size: int = 2048, overlap: int = 200) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works."""
    out: list[str] = []

    def visit(start: int, end: int, level: int) -> None:
        while SEPARATORS[level] and text.find(SEPARATORS[level], start, end) == -1:
            level += 1
        run: list[tuple[int, int]] = []
        for piece in _pieces(text, start, end, SEPARATORS[level]):
            if piece[1] - piece[0] < size or not SEPARATORS[level]:
                run.append(piece)
                continue
            out.extend(_pack(text, run, size, overlap))
            run = []
            visit(*piece, level + 1)
        out.extend(_pack(text, run, size, overlap))

    visit(0, len(text), 0)
    return out
