"""Plain one-machine versions of what the operators return, straight from the contracts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

SPACE = r"[^\x20\x09-\x0D]+"
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    t, out = text or "", []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, (p, group, least) in enumerate(((assign, 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16))):
        out += [(m.start(), k, m.end()) for m in p.finditer(t) if len(m.group(group)) >= least]
    return sorted(out)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{('assign', 'access', 'hex', 'markov')[k]}:{a}:{b}" for a, k, b in spans)


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of (doc_id, text) rows and (item_id, text) rows."""
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = item_words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    lengths, out = sorted({len(w) for w in windows}), []
    for i, t in docs:
        w, hit, found = item_words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"


def pair_model(samples):
    """log P(pair | random) - log P(pair | ordinary) in plain dictionaries. samples: (text, label)."""
    index = {c: i for i, c in enumerate(ALPHABET, 1)}
    counts, size = [Counter(), Counter()], len(ALPHABET) + 1
    for text, label in samples:
        counts[label].update((index.get(a, 0), index.get(b, 0)) for a, b in zip(text, text[1:]))

    def log(label, a, b):
        return math.log((counts[label][a, b] + 0.5) / (sum(counts[label][a, x] for x in range(size)) + 0.5 * size))

    table = {(a, b): log(1, a, b) - log(0, a, b) for a in range(size) for b in range(size)}
    return lambda s: sum(table[index.get(a, 0), index.get(b, 0)] for a, b in zip(s, s[1:])) / (len(s) - 1)


def all_spans(text, ratio, threshold):
    """Base spans, and runs of key characters that the models call random and that no base span touches."""
    base = base_spans(text)
    runs = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or "") if ratio(m[0]) > threshold]
    return sorted(base + [r for r in runs if not any(a < r[2] and r[0] < b for a, _, b in base)])


def statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = re.findall(SPACE, t)
    lines = Counter(x for x in t.split("\n") if re.search(SPACE, x))
    three = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    count = Counter(three)
    inside = {p for k, x in enumerate(three) if count[x] > 1 for p in (k, k + 1, k + 2)}
    n, r = len(w), len(inside)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(lines.values()) - len(lines), r, n < 50 or 100 * r > 50 * n


def url_parts(url: str | None, rules: dict[str, str]) -> tuple[str, str, str | None]:
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def jaccard(docs: list[tuple]) -> dict:
    """doc_id: (class_id, n_links) by comparing all pairs of distinct texts that share a shingle; doc_ids must differ."""
    texts: dict[tuple, list] = {}
    out = {}
    for i, t in docs:
        w = tuple((t or "").lower().split())
        if w:
            texts.setdefault(w, []).append(i)
        else:
            out[i] = (i, 0)
    sets = [{w[k : k + 5] for k in range(max(1, len(w) - 4))} for w in texts]
    places: dict[tuple, list[int]] = {}
    for n, s in enumerate(sets):
        for x in s:
            places.setdefault(x, []).append(n)
    pairs = {(a, b) for p in places.values() for k, a in enumerate(p) for b in p[k + 1 :]}
    label, links = list(range(len(sets))), Counter()

    def top(x: int) -> int:
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        c = len(sets[a] & sets[b])
        if 5 * c >= 4 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            label[top(a)] = top(b)
    groups: dict[int, list] = {}
    ids = list(texts.values())
    for n in range(len(sets)):
        groups.setdefault(top(n), []).append(n)
    for members in groups.values():
        least = min(i for n in members for i in ids[n])
        for n in members:
            for i in ids[n]:
                out[i] = (least, links[n])
    return out


class KneserNey:
    """Two Kneser-Ney models over the characters of words, each on top of one of both classes, in plain dictionaries. rows: (text, label). without: a row whose counts its class gives back."""

    def __init__(self, rows, order, without=None):
        self.order = order
        own = [[], []]
        for text, label in rows:
            own[int(label)] += [g for w in text.split() for g in self.grams(w)]
        self.counts = [Counter(x) for x in own]
        self.levels = {order: self.counts[0] + self.counts[1]}
        for n in range(order, 1, -1):
            self.levels[n - 1] = Counter(g[1:] for g in self.levels[n])
        self.shared_d = {n: self.discount(c) for n, c in self.levels.items()}
        self.d = [self.discount(c) for c in self.counts]
        if without:
            text, label = without
            self.counts[int(label)] = self.counts[int(label)] - Counter(g for w in text.split() for g in self.grams(w))

    def grams(self, word):
        padded = ("^",) * (self.order - 1) + tuple(word) + ("$",)
        return [padded[i : i + self.order] for i in range(len(padded) - self.order + 1)]

    @staticmethod
    def discount(counts):
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    @staticmethod
    def interpolated(counts, d, gram, lower):
        after = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return lower
        return max(counts.get(gram, 0) - d, 0) / total + sum(min(d, c) for c in after.values()) / total * lower

    def ratios(self, word):
        out = []
        for gram in self.grams(word):
            p = 1 / 1024
            for n in range(1, self.order + 1):
                p = self.interpolated(self.levels[n], self.shared_d[n], gram[-n:], p)
            q = [self.interpolated(self.counts[v], self.d[v], gram, p) for v in (0, 1)]
            out.append(math.log(q[1]) - math.log(q[0]))
        return out


def language_grams(text, order=4):
    """The n-grams of a text's letters, other characters as one space, its end filled up."""
    own = f" {re.sub(r'[^a-z]+', ' ', text.lower()).strip()} " + "\0" * (order - 1)
    return [own[i : i + order] for i in range(len(own) - order + 1)]


def language_sets(rows, least_rate):
    """For each language, the n-grams whose rate in it is at least that part of their greatest rate in any."""
    counts = {}
    for text, lang in rows:
        counts.setdefault(lang, Counter()).update(language_grams(text))
    total = {lang: sum(c.values()) for lang, c in counts.items()}
    most = Counter()
    for lang, own in counts.items():
        for g, n in own.items():
            most[g] = max(most[g], n / total[lang])
    return {lang: {g for g, n in own.items() if n / total[lang] >= least_rate * most[g]} for lang, own in counts.items()}


def language_shares(text, sets):
    """For each language, the share of the text's n-grams that it has; nothing for a text without letters."""
    if not re.search("[a-z]", text.lower()):
        return {}
    grams = language_grams(text)
    return {lang: sum(g in own for g in grams) / max(1, len(grams)) for lang, own in sets.items()}


def token_shares(text):
    """The share of each word and pair of neighbours among all of a text; pairs of equal words are one kind."""
    tokens = re.findall(r"\w+|[^\w\s]+", text)
    kinds = Counter(tokens)
    kinds.update(("same",) if a == b else (a, b) for a, b in zip(tokens, tokens[1:]))
    return {k: n / sum(kinds.values()) for k, n in kinds.items()}


class Ftrl:
    """FTRL-proximal, a dictionary entry for each bucket."""

    def __init__(self, features, alpha, beta, l1, l2):
        self.features, self.alpha, self.beta, self.l1, self.l2 = features, alpha, beta, l1, l2
        self.z, self.n = {}, {}

    def weight(self, k):
        z, n = self.z.get(k, 0.0), self.n.get(k, 0.0)
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.beta + n**0.5) / self.alpha + self.l2)

    def score(self, text):
        return 1 / (1 + math.exp(-sum(self.weight(k) * x for k, x in [*self.features(text).items(), ("one", 1.0)])))

    def learn(self, text, label):
        p = self.score(text)
        for k, x in [*self.features(text).items(), ("one", 1.0)]:
            g, n, w = (p - label) * x, self.n.get(k, 0.0), self.weight(k)
            step = ((n + g * g) ** 0.5 - n**0.5) / self.alpha
            self.z[k], self.n[k] = self.z.get(k, 0.0) + g - step * w, n + g * g


def page_rank(edges, seeds, damping, rounds):
    """Personalised PageRank over {(src, dst): n} from {host: weight}; mass at hosts without links is lost."""
    start = {h: w / sum(seeds.values()) for h, w in seeds.items()}
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    rank = start
    for _ in range(rounds):
        moved = Counter({h: (1 - damping) * w for h, w in start.items()})
        for (a, b), n in edges.items():
            moved[b] += damping * rank.get(a, 0.0) * n / out[a]
        rank = dict(moved)
    return {h: r for h, r in rank.items() if r}
