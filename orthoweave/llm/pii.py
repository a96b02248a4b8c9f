"""Personal data: base patterns, and a skip-chain conditional random field that adds spans.

Base spans are the leftmost non-overlapping matches of the four patterns, found in time linear in the text. The field labels the
candidate tokens of a document (white-space tokens with a digit or an @) as email, ip, card, phone or other. Tokens that stand
side by side share a chain potential; distant tokens of equal or similar content (same characters without punctuation and case, same
digits, same last seven or first twelve digits, or same part before an @) share a skip potential, linking each occurrence to the one before it and to the first one, so a token repeated k times
has fewer than 2k links, all of them two steps apart at most. Loopy sum-product message passing runs over all documents of an Arrow
batch as one graph in numpy; each document stops by its own change, so that its result does not depend on its neighbours. A token whose
marginal for a kind reaches `threshold` and that overlaps no base span becomes a further span; base spans always stay.

Weights are learned by pseudo-likelihood, which is a sum over tokens given the labels of their neighbours: whole documents are
labelled by their base spans. Base spans alone would teach the pair weights nothing, as node features give them away; so every base span is
also shown damaged (without plus sign or separators, a digit changed, a domain cut): linked to an intact mention it has that
mention's label, alone or linked to others like it it is other. Tokens of base spans are given when messages are passed. What decides about a damaged mention at a distance from an intact one is therefore the skip potential. Of all their tokens at most `max_train_tokens` are used, chosen by a hash of text and place, from at most
`max_train_docs` documents that hold candidates, chosen by a hash of id and text (both documented parameters).

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; equal texts give equal spans; an
empty table gives an empty result (and an untrained field, which adds nothing); other columns pass through `redact` unchanged.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_share, quoted, stash, text_batches, trimmed

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
ANY = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[^0-9]+")
CORE = re.compile(r"[^0-9a-z@]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind and then start."""
    if not ANY.search(text):
        return []
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # a match holds one @, the whole run of local characters before it, and the domain behind it
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts = [(p.start() + m.start(), p.end() + m.start(), p[0]) for p in re.finditer("[0-9]+", m[0])]
        for i in range(0, len(parts) - 3, 4):
            if all(len(v := p[2].lstrip("0")) <= 3 and int(v or 0) <= 255 for p in parts[i : i + 4]):
                out.append(("ip", parts[i][0], parts[i + 3][1]))
    for kind, pattern in (("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


# ---- the field ----------------------------------------------------------------------------------

N_FEATURES = 25


def similar(tok: str, run: str = "") -> set[str]:
    """The keys that link a token with others; run: the digits of the tokens beside each other up to and with it."""
    digits, local = DIGITS.sub("", tok), tok.lower().partition("@")[0] if "@" in tok else ""
    keys = {"t" + CORE.sub("", tok.lower())}
    if len(digits) >= 6:
        keys.add("d" + digits)
    for d in (digits, run if digits else ""):
        if len(d) >= 7:
            keys.add("e" + d[-7:])
        if 13 <= len(d) <= 19:
            keys.add("c" + d[:12])
    if len(local) >= 4:
        keys.add("m" + local)
    return {k for k in keys if len(k) > 3}


def damaged(mention: str, kind: str, way: int) -> str:
    """A mention as it may stand elsewhere, outside the patterns."""
    digits = DIGITS.sub("", mention)
    if kind == "email":
        local, _, domain = mention.partition("@")
        return f"{local}@{domain.partition('.')[0]}" if way else f"{local}@{domain.replace('.', '(dot)')}"
    if kind == "ip":
        return mention.replace(".", "-" if way else "_")
    if kind == "card":
        return digits[:-1] + (str((int(digits[-1]) + 1) % 10) if way else "")
    return digits if way else mention.lstrip("+")


def _features(tok: str) -> list[float]:
    n, d = len(tok), sum(c.isdigit() for c in tok)
    a = sum(c.isalpha() for c in tok)
    at, dots, dashes = tok.count("@"), tok.count("."), tok.count("-")
    return [
        1, at == 1, at > 1, at > 0 and "." in tok.rpartition("@")[2], d == 0, d == 1, 2 <= d <= 3, 4 <= d <= 6, 7 <= d <= 8, 9 <= d <= 12, 13 <= d <= 15, 16 <= d <= 19, d > 19,
        a == 0, a > 0 and d > 0, dots == 3, 0 < dots < 3, dashes > 0, tok[0] == "+", tok[0] == "(", tok[-1] == ")", "=" in tok or '"' in tok, n > 20, d == n, 16 <= d <= 19 and luhn(DIGITS.sub("", tok)),
    ]


class Graph:
    """Candidate tokens of many documents, their chain and skip links."""

    def __init__(self, texts: list[str | None]):
        self.doc, self.start, self.end, feats, chain, skip = [], [], [], [], [], []
        for k, text in enumerate(texts):
            if not text or not ANY.search(text):
                continue
            seen: dict[str, int] = {}
            firsts: dict[str, int] = {}
            before, run = -1, ""
            for m in TOKEN.finditer(text):
                tok = m[0]
                if not ANY.search(tok):
                    before = -1
                    continue
                i = len(self.doc)
                self.doc.append(k), self.start.append(m.start()), self.end.append(m.end())
                feats.append(_features(tok))
                beside = before >= 0
                if beside:
                    chain.append((before, i))
                before = i
                run = (run if beside else "")[-19:] + DIGITS.sub("", tok)
                keys = similar(tok, run)
                for last in sorted({at[key] for key in keys for at in (seen, firsts) if key in at}):
                    if last != i - 1 or not beside:
                        skip.append((last, i))
                for key in keys:
                    seen[key] = i
                    firsts.setdefault(key, i)
        self.x = np.array(feats, float).reshape(-1, N_FEATURES)
        self.edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        self.kind = np.array([0] * len(chain) + [1] * len(skip), np.int64)

    def labels(self, spans: list[list[Span]]) -> np.ndarray:
        """0 for other, else 1 + the kind of a base span that covers most of the token."""
        out = np.zeros(len(self.doc), np.int64)
        by = {}
        for i, k in enumerate(self.doc):
            by.setdefault(k, []).append(i)
        for k, tokens in by.items():
            ends = [self.end[i] for i in tokens]
            for kind, s, e in spans[k]:
                lo = bisect_right(ends, s)
                for i in tokens[lo:]:
                    if self.start[i] >= e:
                        break
                    if 2 * (min(e, self.end[i]) - max(s, self.start[i])) > self.end[i] - self.start[i]:
                        out[i] = 1 + KINDS.index(kind)
        return out


#: The score of a label that is known.
GIVEN = 50.0


class Field:
    """Weights: node [features, labels], pair [chain or skip, label, label]."""

    def __init__(self):
        self.node, self.pair, self.trained = np.zeros((N_FEATURES, 5)), np.zeros((2, 5, 5)), False

    def marginals(self, g: Graph, known: np.ndarray | None = None, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product beliefs of the tokens; tokens of base spans (`known` > 0, a label) are given. Sums run in one order for a
        document, whatever stands beside it."""
        phi = np.zeros((len(g.x), 5))
        for j in range(N_FEATURES):
            phi += g.x[:, j : j + 1] * self.node[j]
        if known is not None:
            given = np.flatnonzero(known)
            phi[given] = GIVEN * (np.arange(5) == known[given, None])
        if len(g.edges):
            src = np.concatenate([g.edges[:, 0], g.edges[:, 1]])
            dst = np.concatenate([g.edges[:, 1], g.edges[:, 0]])
            m, back = len(g.edges), np.arange(2 * len(g.edges))
            back = np.concatenate([back[m:], back[:m]])
            psi = np.concatenate([self.pair[g.kind], self.pair[g.kind].transpose(0, 2, 1)])
            msg, doc = np.zeros((2 * m, 5)), np.array(g.doc, np.int64)[dst]
            live = np.ones(2 * m, bool)
            for _ in range(rounds):
                total = phi.copy()
                for c in range(5):
                    total[:, c] += np.bincount(dst, msg[:, c], len(phi))
                out = (total[src] - msg[back])[:, :, None] + psi
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                change = np.zeros(int(doc.max()) + 1)
                np.maximum.at(change, doc, np.abs(new - msg).max(1))
                live &= change[doc] >= 1e-4
                if not live.any():
                    break
                msg = np.where(live[:, None], damping * msg + (1 - damping) * new, msg)
            for c in range(5):
                phi[:, c] += np.bincount(dst, msg[:, c], len(phi))
        p = np.exp(phi - phi.max(1, keepdims=True)) if len(phi) else phi
        return p / p.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, near: np.ndarray, steps: int = 1000, rate: float = 0.5, l2: float = 1e-4) -> Field:
        """Pseudo-likelihood of tokens (features x, labels y) given `near`, the labels of their neighbours counted [link, token, label]."""
        if not len(y):
            return self
        onehot = np.eye(5)[y]
        vn, vp = np.zeros_like(self.node), np.zeros_like(self.pair)
        for _ in range(steps):
            s = x @ self.node + near[0] @ self.pair[0] + near[1] @ self.pair[1]
            p = np.exp(s - s.max(1, keepdims=True))
            r = onehot - p / p.sum(1, keepdims=True)
            vn = 0.9 * vn + rate * (x.T @ r / len(y) - l2 * self.node)
            gp = np.stack([near[k].T @ r / len(y) for k in (0, 1)])
            vp = 0.9 * vp + rate * ((gp + gp.transpose(0, 2, 1)) / 2 - l2 * self.pair)
            self.node, self.pair = self.node + vn, self.pair + vp
        self.trained = True
        return self


def all_spans(texts: list[str | None], field: Field, threshold: float = 0.7) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans that the field adds) of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    if field.trained:
        g = Graph(texts)
        if len(g.doc):
            p = field.marginals(g, g.labels(base))
            best = p.argmax(1)
            taken: dict[int, list] = {}
            for i in np.flatnonzero((best > 0) & (p.max(1) >= threshold)).tolist():
                k, s, e = g.doc[i], g.start[i], g.end[i]
                if k not in taken:
                    taken[k] = _merged(base[k])
                if _free(taken[k], s, e):
                    last = added[k][-1] if added[k] else None
                    kind = KINDS[best[i] - 1]
                    if last and last[0] == kind and i and g.doc[i - 1] == k and g.end[i - 1] == last[2] and not texts[k][last[2] : s].strip():
                        added[k][-1] = (kind, last[1], e)
                    else:
                        added[k].append((kind, s, e))
            for k, spans in enumerate(added):
                added[k] = sorted(((kind, *_trim(texts[k], s, e)) for kind, s, e in spans), key=_order)
    return list(zip(base, added, strict=True))


def _trim(text: str, s: int, e: int) -> tuple[int, int]:
    """Without punctuation at either end."""
    while e - s > 1 and not (text[e - 1].isalnum()):
        e -= 1
    while e - s > 1 and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    return s, e


def _order(span: Span):
    return KINDS.index(span[0]), span[1], span[2]


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans."""
    starts, ends = [], []
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s), ends.append(e)
    return starts, ends


def _free(merged: tuple[list[int], list[int]], s: int, e: int) -> bool:
    i = bisect_right(merged[1], s)
    return i >= len(merged[0]) or merged[0][i] >= e


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ---- columns ------------------------------------------------------------------------------------


def neighbours(g: Graph, y: np.ndarray) -> np.ndarray:
    """How many neighbours of each label a token has, by link: [link, token, label]."""
    onehot = np.eye(5)[y]
    near = np.zeros((2, len(y), 5))
    for kind in (0, 1):
        e = g.edges[g.kind == kind]
        np.add.at(near[kind], e[:, 0], onehot[e[:, 1]])
        np.add.at(near[kind], e[:, 1], onehot[e[:, 0]])
    return near


def train_field(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train_docs: int = 2000, max_train_tokens: int = 60_000) -> Field:
    """A field learned from at most `max_train_tokens` tokens of at most `max_train_docs` documents with candidate tokens."""
    text_batches(docs.sparkSession)
    text = F.col(text_col)
    found = docs.filter(text.rlike("[0-9@]")).select(F.col(id_col).alias("i"), text.alias("t"))
    few = hashed_share(found, ["i", "t"], max_train_docs).select(F.xxhash64("t").alias("h"), "t").dropDuplicates(["h"])
    tokens = stash(few.mapInArrow(trimmed(_tokens_of), "h long, at long, x array<float>"), "pii-tokens")
    rows = hashed_share(tokens, ["h", "at"], max_train_tokens).toPandas().sort_values(["h", "at"], kind="stable")
    discard(tokens)
    if rows.empty:
        return Field()
    flat = np.array(rows["x"].tolist(), np.float64)
    near = flat[:, 1 + N_FEATURES :].reshape(-1, 2, 5).transpose(1, 0, 2)
    return Field().fit(flat[:, 1 : 1 + N_FEATURES], flat[:, 0].astype(np.int64), near)


def _tokens_of(batches):
    """Of each sampled document, every token's label, features and neighbours' labels (no text)."""
    for b in batches:
        for h, t in zip(b.column("h").to_pylist(), b.column("t").to_pylist(), strict=True):
            g = Graph([t])
            spans = base_spans(t)
            y = g.labels([spans])
            near = neighbours(g, y).transpose(1, 0, 2).reshape(len(y), 10)
            shown = []
            for kind, start, end in spans:
                k = 1 + KINDS.index(kind)
                for n in range(6):
                    for m in TOKEN.finditer(damaged(t[start:end], kind, n % 2)):
                        if ANY.search(m[0]):
                            x, link, none = _features(m[0]), np.zeros(10), np.zeros(10)
                            # linked with the mention before, and perhaps the first one, beside none, its own or other tokens; or with no mention
                            link[5 + k], link[k if n % 3 == 1 else 0], none[0] = 1 + n // 3, n % 3, n % 3
                            like = none.copy()
                            like[5] = link[5 + k]  # by another one like it
                            shown += [[k, *x, *link], [0, *x, *none], [0, *x, *like]]
            own = np.concatenate([y[:, None], g.x, near], 1)
            flat = np.concatenate([own, np.array(shown).reshape(-1, own.shape[1])]).astype(np.float32)
            for lo in range(0, len(flat), 20_000):
                part = flat[lo : lo + 20_000]
                x = pa.ListArray.from_arrays(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32), part.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), h)), pa.array(np.arange(lo, lo + len(part))), x], ["h", "at", "x"])


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, base and added: arrays of (kind, start, end) structs."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            found = all_spans(b.column(1).to_pylist(), held.value, threshold)
            cols = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "base", "added"])

    return docs.select(id_col, text_col).mapInArrow(trimmed(run), f"`{id_col}` {kind}, base array<struct<kind:string,start:bigint,end:bigint>>, added array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, field: Field, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The same rows and columns, with every span of `text_col` replaced by its kind in angle brackets."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(quoted(c)) for c in others]) if others else F.struct(F.lit(0))
    rows = docs.select(rest.alias("rest"), F.col(quoted(text_col)).alias("text"))  # one column, whatever names there are

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out = []
            for text, (base, added) in zip(texts, all_spans(texts, held.value, threshold), strict=True):
                out.append(text if not base and not added else replaced(text, base + added))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["rest", "text"])

    out = rows.mapInArrow(trimmed(run), rows.schema)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])


def replaced(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one, named by the first."""
    out, done = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[done:s], f"<{kind.upper()}>"]
        done = e
    return "".join([*out, text[done:]])


def op7_pii(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train_field(docs))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    rank = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(rank)).alias("spans"), F.size("added").cast("long").alias("n_added"))
