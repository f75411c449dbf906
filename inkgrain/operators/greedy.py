"""Greedy matching of the quads of whole images, in arrays: the rule of ``detection.match`` for what one task holds."""

from __future__ import annotations

import numpy as np
import pandas as pd

from inkgrain.functions.geometry import overlap

BLOCK = 10**9  #: predictions looked up at a time, times the truths that they may meet


def _area(x: np.ndarray, y: np.ndarray, n: np.ndarray | int = 4) -> np.ndarray:
    """Signed areas of polygons (columns) with *n* corners, added up in order of the corners and with what rounding loses,
    as ``sum`` does it."""
    total, lost = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(len(x)):
        after = [np.where(k + 1 < n, c[(k + 1) % len(x)], c[0]) for c in (x, y)]
        more = np.where(k < n, x[k] * after[1] - after[0] * y[k], 0.0)
        now = total + more
        lost += np.where(np.abs(total) >= np.abs(more), (total - now) + more, (more - now) + total)
        total = now
    return (total + lost) / 2


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """IoU and the shared part of the first of each two quads (rows of eight numbers): ``geometry.overlap`` for many, with
    the same operations in the same order."""
    quads, convex = [], np.ones(len(a), bool)
    for q in (a, b):
        x, y = np.ascontiguousarray(q[:, 0::2].T), np.ascontiguousarray(q[:, 1::2].T)
        back = _area(x, y) < 0
        x, y = np.where(back, x[::-1], x), np.where(back, y[::-1], y)
        dx, dy = np.roll(x, -1, 0) - x, np.roll(y, -1, 0) - y
        convex &= (dx * np.roll(dy, -1, 0) - dy * np.roll(dx, -1, 0) >= 0).all(0)
        quads.append((x, y))
    (px, py), (bx, by) = quads
    s, t = np.abs(_area(px, py)), np.abs(_area(bx, by))
    n = np.full(len(a), 4)
    for k in range(4):
        x0, y0, x1, y1 = bx[k], by[k], bx[(k + 1) % 4], by[(k + 1) % 4]
        side = (x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)
        rows = len(px)
        cx, cy, m = np.zeros((rows + 1, len(a))), np.zeros((rows + 1, len(a))), np.zeros(len(a), np.int64)
        for i in range(rows):
            more = i + 1 < n
            su, sv = side[i], np.where(more, side[(i + 1) % rows], side[0])
            r = np.flatnonzero((i < n) & (su >= 0) & (m <= rows))
            cx[m[r], r], cy[m[r], r] = px[i, r], py[i, r]
            m[r] += 1
            crosses = (i < n) & (((su > 0) & (sv < 0)) | ((su < 0) & (sv > 0)))
            convex &= ~crosses | (m <= rows)  # a convex one gains one corner at most
            r = np.flatnonzero(crosses & (m <= rows))
            f = su[r] / (su[r] - sv[r])
            to = np.where(more[r], (i + 1) % rows, 0)
            cx[m[r], r], cy[m[r], r] = px[i, r] + f * (px[to, r] - px[i, r]), py[i, r] + f * (py[to, r] - py[i, r])
            m[r] += 1
        px, py, n = cx, cy, m
    both = np.where((n > 2) & (s > 0) & (t > 0), np.abs(_area(px, py, n)), 0.0)
    for i in np.flatnonzero(~convex):
        s[i], t[i], both[i] = overlap(a[i].tolist(), b[i].tolist())
    union = s + t - both
    return np.divide(both, union, out=np.zeros(len(a)), where=union > 0), np.divide(both, s, out=np.zeros(len(a)), where=s > 0)


class Index:
    """Quads by image, class of size (powers of two of width and height) and place, in squares of their class."""

    def __init__(self, img: np.ndarray, quads: np.ndarray):
        self.quads, self.img = quads, img
        self.box = np.stack([quads[:, 0::2].min(1), quads[:, 1::2].min(1), quads[:, 0::2].max(1), quads[:, 1::2].max(1)], 1) if len(quads) else np.zeros((0, 4))
        self.area = np.abs(_area(quads[:, 0::2].T, quads[:, 1::2].T))
        size = self.box[:, 2:] - self.box[:, :2]
        power = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) if len(quads) else np.zeros((0, 2), np.int64)
        self.low = self.box[:, :2].min(0) if len(quads) else np.zeros(2)
        self.classes = []
        for w, h in np.unique(power, axis=0):
            own = np.flatnonzero((power[:, 0] == w) & (power[:, 1] == h))
            cell = np.array([2.0**w, 2.0**h]) / 2
            at = np.floor((self.box[own, :2] - self.low) / cell).astype(np.int64)
            wide, tall = at.max(0) + 1
            key = (img[own] * tall + at[:, 1]) * wide + at[:, 0]
            order = np.argsort(key, kind="stable")
            self.classes.append((own[order], key[order], cell, wide, tall, self.area[own].min()))

    def near(self, img: np.ndarray, box: np.ndarray, area: np.ndarray, least: float, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """``(i, j)``: given quads and indexed ones whose boxes share the part *least* of the first one's area, or of what both
        cover (*both*).  What two quads share lies within what their boxes share."""
        mine, theirs = [], []
        size = box[:, 2:] - box[:, :2]
        for own, key, cell, wide, tall, smallest in self.classes:
            # neither width nor height of what is shared exceeds that of either box
            room = np.minimum(size, 2 * cell).prod(1) * 1.000001
            fit = np.flatnonzero((room >= area * least) & ((room >= smallest * least) | (not both)))
            if not len(fit):
                continue
            # and so much of each must be shared at least
            span = least * 0.999999 * area[fit, None] / np.minimum(size[fit], 2 * cell)[:, ::-1]
            lo = np.maximum(np.floor((box[fit, :2] + span - 2 * cell - self.low) / cell).astype(np.int64), 0)
            hi = np.minimum(np.floor((box[fit, 2:] - span - self.low) / cell).astype(np.int64), [wide - 1, tall - 1])
            rows = np.where((hi >= lo).all(1), hi[:, 1] - lo[:, 1] + 1, 0)
            q = np.repeat(np.arange(len(fit)), rows)
            y = lo[q, 1] + np.arange(len(q)) - np.repeat(np.cumsum(rows) - rows, rows)
            base = (img[fit][q] * tall + y) * wide
            begin, end = np.searchsorted(key, base + lo[q, 0]), np.searchsorted(key, base + hi[q, 0], "right")
            many = end - begin
            i = np.repeat(fit[q], many)
            j = own[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(i))]
            shared = np.minimum(box[i, 2], self.box[j, 2]) - np.maximum(box[i, 0], self.box[j, 0])
            up = np.minimum(box[i, 3], self.box[j, 3]) - np.maximum(box[i, 1], self.box[j, 1])
            keep = (shared > 0) & (up > 0)
            shared = shared * up * 1.000001
            keep &= shared * (1 + least) >= (area[i] + self.area[j]) * least if both else shared >= area[i] * least
            mine.append(i[keep])
            theirs.append(j[keep])
        if not mine:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(mine), np.concatenate(theirs)


def match_images(part: pd.DataFrame, thresholds: list[float], cover: float) -> pd.DataFrame:
    """``(thr, tp, ex)`` of whole images, rows ``(img, pos, kind, p0 ... p7)``: matches, and unmatched predictions that meet
    a do-not-care region.  Holds the quads and the overlaps of a block of predictions, never all overlaps."""
    part = part.sort_values("pos", kind="stable")
    img = pd.factorize(part["img"])[0].astype(np.int64)
    quads = part[[f"p{i}" for i in range(8)]].to_numpy(np.float64)
    whole = ~np.isnan(quads).any(1)
    of = lambda kind: np.flatnonzero((part["kind"] == kind).to_numpy() & whole)
    at = of("gt")
    truth = Index(img[at], quads[at])
    at = of("dontcare")
    care = Index(img[at], quads[at])
    at = of("pred")
    at = at[np.argsort(img[at], kind="stable")]
    pred_img, pred = img[at], quads[at]
    box = np.stack([pred[:, 0::2].min(1), pred[:, 1::2].min(1), pred[:, 0::2].max(1), pred[:, 1::2].max(1)], 1) if len(pred) else np.zeros((0, 4))
    area = np.abs(_area(pred[:, 0::2].T, pred[:, 1::2].T))
    low = min(thresholds)
    used = [np.zeros(len(truth.quads), bool) for _ in thresholds]
    tp, ex = [0] * len(thresholds), [0] * len(thresholds)
    step = int(min(max(BLOCK // (len(truth.quads) + len(care.quads) + 1), 128), 4096))
    for start in range(0, len(pred), step):
        b = slice(start, start + step)
        p_img, p_box, p_area, p = pred_img[b], box[b], area[b], pred[b]
        left = np.zeros((len(thresholds), len(p)), bool)
        i, j = truth.near(p_img, p_box, p_area, low, True)
        open_ = ~np.logical_and.reduce([u[j] for u in used]) & (p_area[i] > 0)
        i, j = i[open_], j[open_]
        iou = overlaps(p[i], truth.quads[j])[0]
        order = np.lexsort((j, -iou, i))  # truths are numbered in order of pos
        order = order[iou[order] >= low]
        i, j, iou = i[order], j[order], iou[order]
        for k, thr in enumerate(thresholds):
            take = (iou >= thr) & ~used[k][j]
            done, gone, served = -1, used[k], []
            for x, y in zip(i[take].tolist(), j[take].tolist()):
                if x != done and not gone[y]:
                    gone[y] = True
                    done = x
                    served.append(x)
            tp[k] += len(served)
            left[k] = True
            left[k, served] = False
        some = np.flatnonzero(left.any(0) & (p_area > 0))
        i, j = care.near(p_img[some], p_box[some], p_area[some], min(low, cover), False)
        iou, held = overlaps(p[some][i], care.quads[j])
        for k, thr in enumerate(thresholds):
            met = np.zeros(len(p), bool)
            met[some[i[(iou >= thr) | (held >= cover)]]] = True
            ex[k] += int((met & left[k]).sum())
    return pd.DataFrame({"thr": [float(t) for t in thresholds], "tp": tp, "ex": ex})
