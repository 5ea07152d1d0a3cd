"""The main text of a page by the rules that html_text states, one line and one path at a time, for tests."""

import math
import re
from html.parser import HTMLParser

from sparkloom.llm import html_text as H


class Tree(HTMLParser):
    """Elements as (name, attributes, number) and lines as (pieces, tags, path); a piece is (path, in heading, text)."""

    def __init__(self):
        super().__init__()
        self.path, self.lines, self.pieces, self.tags, self.number = [("", {}, 0)], [], [], 0, 0
        self.elements = {0: tuple(self.path)}

    def cut(self):
        if self.pieces:
            self.lines.append((self.pieces, self.tags, tuple(self.path)))
            self.pieces, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in H.BLOCKS:
            self.cut()
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag == "body" and "head" in [e[0] for e in self.path]:
            del self.path[[e[0] for e in self.path].index("head") :]
        if tag in H.ENDS:
            for k in range(len(self.path) - 1, 0, -1):
                if self.path[k][0] in H.ENDS[tag]:
                    del self.path[k:]
                    break
                if self.path[k][0] in H.SCOPES:
                    break
        if tag not in H.VOID:
            self.number += 1
            self.path.append((tag, dict(attrs), self.number))
            self.elements[self.number] = tuple(self.path)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in H.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in H.BLOCKS:
            self.cut()
        self.tags += 1
        names = [e[0] for e in self.path]
        if tag in names[1:]:
            del self.path[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.pieces.append((tuple(self.path), data))


def role(path):
    return H.role_of(path[-1][0], path[-1][1], "article" in [e[0] for e in path[:-1]]) if len(path) > 1 else H.STAYS


def gone(path):
    return any(role(path[: k + 1]) == H.GONE for k in range(len(path)))


def main_text(html, clustered=None):
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    tree.cut()
    number = lambda path: path[-1][2]
    size = {n: sum(len(t.strip()) for pieces, _, _ in tree.lines for path, t in pieces if path[: len(own)] == own and not gone(path)) for n, own in tree.elements.items()}
    sized = lambda name: [p for n, p in tree.elements.items() if p[-1][0] == name and not gone(p) and (size[n] or name == "h1")]
    articles = sized("article")
    kept = [p for p in articles if 2 * size[number(p)] >= max(size[number(q)] for q in articles)] + sized("main")
    wanted = kept + ([] if articles else sized("h1"))

    def named_out(path):
        if role(path) != H.NAMED or any(w[: len(path)] == path for w in wanted):
            return False
        inside = next((path[:k] for k in range(len(path) - 1, 0, -1) if path[:k] in kept), None)
        if inside is None and kept:
            return True
        return not 2 * size[number(path)] > size[number(inside) if inside else 0] > 0

    left_out = lambda path: gone(path) or any(named_out(path[: k + 1]) for k in range(len(path)))
    lines, tags = [], 0
    for pieces, more, path in tree.lines:
        tags += more
        stay = []
        for own, text in pieces:
            names = [e[0] for e in own]
            if not left_out(own) and ("header" not in names or H.HEADINGS & set(names)):
                stay.append((own, text))
        text = re.sub(r"[ \t-\r]+", " ", "".join(t for _, t in stay)).strip(" ")
        if text:
            link = not H.HEADINGS & {e[0] for e in path} and all("a" in [e[0] for e in own] or not t.strip() for own, t in stay)
            hinted = any(role(path[: k + 1]) == H.HINT for k in range(len(path)))
            lines.append((text, tags, path, link, hinted))
            tags = 0
    if not lines:
        return ""
    ratios = [len(t) / max(1, n) * (H.HINTED if h else 1) for t, n, _, _, h in lines]
    weight = lambda d: math.exp(-(d**2) / (2 * H.SIGMA**2))
    smooth = []
    for k in range(len(ratios)):
        near = [j for j in range(len(ratios)) if abs(j - k) <= H.RADIUS]
        smooth.append(sum(ratios[j] * weight(j - k) for j in near) / sum(weight(j - k) for j in near))
    mean = sum(smooth) / len(smooth)
    limit = min(H.THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)), max(smooth))
    clusters = [k for k, x in enumerate(smooth) if x >= limit] if clustered is None else clustered(len(lines))
    texts = [k for k in clusters if not lines[k][3]]
    core = [k for k in texts if ratios[k] >= limit or clustered is not None] or texts or clusters
    paths = [lines[k][2] for k in core]
    depth = 1
    while all(len(p) > depth and p[: depth + 1] == paths[0][: depth + 1] for p in paths):
        depth += 1
    at = paths[0][:depth]
    bounds = [d for d in range(1, len(at) + 1) if at[d - 1][0] in ("article", "main")]
    inner = [d for d in bounds if at[d - 1][0] == "article"]
    least = bounds[0] if bounds else 1
    at = at[: inner[0] if inner else bounds[0] if bounds else len(at)]
    within = lambda path, own: path[: len(own)] == own
    while len(at) > least and not any(link and within(p, at[:-1]) and not within(p, at) for _, _, p, link, _ in lines):
        at = at[:-1]
    inside = [k for k, line in enumerate(lines) if within(line[2], at)]
    if not bounds:
        box = lambda p: next((p[: d + 1] for d in range(len(p) - 1, len(at) - 1, -1) if p[d][0] in H.BOXES), None)
        full = lambda own: own is None or any(within(lines[k][2], own) for k in core)
        inside = [k for k in inside if core[0] <= k <= core[-1] or full(box(lines[k][2]))]
    return "\n".join(lines[k][0] for k in inside)
