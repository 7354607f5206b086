"""Lines of text by the widths of its glyphs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Glyphs:
    """Advances of a font's characters in pixels; characters that aren't listed are ``other`` wide."""

    def __init__(self, advances: dict[str, float], other: float):
        codes = np.array(sorted(map(ord, advances)), np.int64)
        self.codes, self.widths, self.other = codes, np.array([advances[chr(c)] for c in codes], np.float64), float(other)
        self.blank = float(advances.get(" ", other))

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.full(len(codes), self.other)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.widths[at], self.other)


def lines_of(widths: np.ndarray, blank: float, most: float) -> list[tuple[int, int]]:
    """(first, end) word of each line: as many words as fit, one at least; a last line of one word gets the word before it, if that line keeps two.

    A line's last word is found by binary search over the sums of widths.
    """
    n = len(widths)
    ends = np.cumsum(widths + blank)  # each word with a blank after it
    out, i = [], 0
    while i < n:
        before = ends[i - 1] if i else 0.0
        j = max(i + 1, int(np.searchsorted(ends, before + most + blank + 1e-9, "right")))
        out.append((i, j))
        i = j
    if len(out) > 1 and out[-1][1] - out[-1][0] == 1 and out[-2][1] - out[-2][0] > 2 and widths[-2] + blank + widths[-1] <= most + 1e-9:
        out[-2:] = [(out[-2][0], out[-2][1] - 1), (out[-1][0] - 1, out[-1][1])]
    return out


def wrap_measured(words: Column, most: float, glyphs: Glyphs) -> Column:
    """Lines (array of strings) of words (array), no wider than most pixels: a line of one word may be wider.

    The widths of a whole batch of texts are looked up and added up at once. Null or no words: no lines.
    """

    @F.pandas_udf("array<string>")
    def lines(texts: pd.Series) -> pd.Series:
        lists = [[] if t is None else list(t) for t in texts]
        flat = [w for ws in lists for w in ws]
        codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sums = np.concatenate([[0.0], np.cumsum(glyphs.of(codes))])
        ends = np.cumsum([len(w) for w in flat], dtype=np.int64) if flat else np.zeros(0, np.int64)
        widths = np.round(sums[ends] - sums[np.concatenate([[0], ends[:-1]]) if flat else ends], 6)
        out, at = [], 0
        for ws in lists:
            out.append([" ".join(ws[i:j]) for i, j in lines_of(widths[at : at + len(ws)], glyphs.blank, most)])
            at += len(ws)
        return pd.Series(out, dtype=object)

    return lines(words)
