"""Personal data: pattern matches, completed by a skip-chain conditional random field over each document.

*Base spans*: emails, IPv4 addresses, payment cards (Luhn) and international phone numbers, leftmost and without overlap per
kind; matches that fail their check are dropped without another try. Every scan is linear in the text.

*Field*: nodes are the tokens (runs without white space) that hold a digit, ``@`` or ``+``; all others are no entity. Labels
are none, the base kinds, and ``secret`` (keys and passwords, which have no base pattern). Unary potentials come from
features of a token: its shape, what its digits check to, and the words before it. Edges, each kind with its own potentials:

* chain edges join each node to the next one, close by (two characters or fewer) or further off (``FAR`` characters or fewer);
* skip edges join all nodes with the same letters and digits to a hub, however far apart and many they are, in linear size. Such a
  hub is observed where base spans hold a mention of it: it has their labels, which the open mentions can't outvote;
* similar tokens, with the same last seven digits or the same letters around other digits, share a hub of a weaker kind.

Loopy sum-product messages run over all documents of a batch at once until those of a document settle (``ROUNDS`` only stops
messages that swing for ever). Nodes outside the base spans whose entity label has a marginal of ``SURE`` or more become
spans; neighbours with one label are joined. Base spans always stay.

*Learning*: labels of at most ``SAMPLE`` documents (chosen by a hash) are their base spans, and for secrets the values that are
assigned to a name such as *token* or *password*. Around each known entity three sorts of text are made: the entity in another form
(other separators, no plus sign, the @ spelled out, the key word before it masked), the same beside a clear mention of it, and a near
miss (a wrong check digit, a part over 255, too few digits), which is no entity. Unary weights and pair potentials are fitted together by
pseudo-likelihood: each node given the labels of its neighbours, given its features alone, and given its neighbours and next to no
features. Spark counts the distinct (label, features, labels
of neighbours); the driver fits on the ``EXAMPLES`` most frequent of them. Unlabelled tokens that a skip edge joins to a labelled one, and
those close beside them, are left out.

Definitions that hold for every row: a null text is empty and has no spans; repeated rows give equal results; a null
``doc_id`` is processed like others; without any candidate token in the sample only base spans are found; an empty
table gives an empty result; extra columns are ignored, whatever their names. Offsets are code points, ends exclusive. Texts are
taken in batches of ``BATCH_NODES`` nodes or so, a longer text alone and whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.text import small

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
NEAR, SAME, FARTHER, SIMILAR = range(4)  # kinds of edges
SAMPLE = 20_000
EXAMPLES = 40_000
FAR = 200
HASHED = 1 << 12
ROUNDS = 500
SETTLED = 1e-8
SURE = 0.6
BATCH_NODES = 50_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPACES = frozenset(" \t\n\x0b\x0c\r")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NODE = re.compile(r"[0-9@+]")
SPACE = re.compile(r"[\x20\x09-\x0D]")
CORE = re.compile(r"^[^0-9A-Za-z+(]*|[^0-9A-Za-z)]*$")
RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
NO_DIGIT = re.compile(r"[^0-9]")
NO_WORD = re.compile(r"[\W_]+")
WORD = re.compile(r"[^\W\d_]+")
HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
SPELLED = re.compile(r"^[^@]*[(\[{<](?:at|@)[)\]}>]", re.I)
#: Names to which secrets are assigned: they label the sample, nothing else.
SEED = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth)\b[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?([A-Za-z0-9+/_-]{12,})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match holds one ``@``: its local part is the run before it, so each ``@`` is tried once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ip_fits(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if NODE.search(text):
        for m in IP.finditer(text):
            if _ip_fits(m[0]):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def nodes(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens that hold a digit, ``@`` or ``+``, without punctuation around them."""
    out, at = [], 0
    while m := NODE.search(text, at):
        start = m.start()
        while start > at and text[start - 1] not in SPACES:
            start -= 1
        stop = SPACE.search(text, m.start())
        at = stop.start() if stop else len(text)
        token = text[start:at]
        left, right = start + CORE.match(token).end(), at
        while right > left and not (text[right - 1].isalnum() or text[right - 1] == ")"):
            right -= 1
        if right > left:
            out.append((left, right))
    return out


def shape(token: str) -> str:
    """Runs of letters and digits of a token; of very long tokens the two ends, and that they are long."""
    short = token if len(token) <= 160 else token[:80] + "~" + token[-80:]
    return RUNS.sub(lambda m: f"d{min(len(m[0]), 20)}" if m[0][0].isdigit() else "a", short)


def features(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, ...]]:
    """Feature names of each node; checks on whole tokens are features, their results are not copied from the base."""
    out = []
    shapes = [shape(text[s:e]) for s, e in spans]
    for i, (s, e) in enumerate(spans):
        token = text[s:e]
        digits = NO_DIGIT.sub("", token)
        before = shapes[i - 1] if i and s - spans[i - 1][1] <= 2 else "-"
        after = shapes[i + 1] if i + 1 < len(spans) and spans[i + 1][0] - e <= 2 else "-"
        f = [f"s:{shapes[i]}", f"b:{before}", f"a:{after}", f"n:{min(len(digits), 20)}"]
        context = text[max(0, s - 40) : s].rpartition("\n")[2]
        words = WORD.findall(context)
        if words:
            f.append(f"w:{words[-1].lower()[:16]}")
        sign = context.rstrip(" \"'(")[-1:]
        if sign and not sign.isalnum():
            f.append(f"g:{sign}")
        if "@" in token:
            f.append("at:" + ("." if "." in token.rpartition("@")[2] else ""))
        elif SPELLED.match(token[:200]):
            f.append("spelled" + ("." if "." in token else ""))
        if token[0] == "+":
            f.append("plus")
        if 12 <= len(digits) <= 19 and len(digits) * 2 > len(token):
            f.append("luhn" if luhn(digits) else "no luhn")
        parts = re.split(r"[^0-9]+", token) if len(token) <= 24 else ()
        if len(parts) == 4 and all(parts):
            name = "quad" if IP.fullmatch(token) else "four"
            f.append(name if all(int(x) <= 255 for x in parts) else f"no {name}")
        letters = len(token) - len(digits)
        if len(token) >= 16 and letters and digits and token.isalnum():
            f.append("mixed:" + str(min(len(token) // 8, 6)))
            f.append("hex" if HEX.fullmatch(token) else "no hex")
            f.append("turns:" + str(min(shapes[i].count("a") + shapes[i].count("d"), 12) // 3))
        out.append(tuple(f))
    return out


def _groups(keys: list[tuple[int, str]]) -> list[list[int]]:
    groups: dict[str, list[int]] = {}
    for j, key in keys:
        groups.setdefault(key, []).append(j)
    return [g for g in groups.values() if len(g) > 1]


def mentions(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Groups of two nodes or more with the same letters and digits."""
    keys = ((j, NO_WORD.sub("", text[s:e]).lower()) for j, (s, e) in enumerate(spans))
    return _groups([(j, k) for j, k in keys if len(k) >= 4])


def similar(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Groups of two nodes or more that are written alike: the same last seven digits, or the same eight letters or more with
    other digits between."""
    keys = []
    for j, (s, e) in enumerate(spans):
        token = text[s:e]
        digits = NO_DIGIT.sub("", token)
        if len(digits) >= 7:
            keys.append((j, "d" + digits[-7:]))
        letters = "".join(WORD.findall(token)).lower()
        if len(letters) >= 8:
            keys.append((j, "l" + letters))
    return _groups(keys)


def chain(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, i + 1, kind) of neighbours in the text."""
    gaps = ((j, spans[j][0] - spans[j - 1][1]) for j in range(1, len(spans)))
    return [(j - 1, j, NEAR if gap <= 2 else FARTHER) for j, gap in gaps if gap <= FAR]


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values assigned to the name of a secret; they hold letters and digits."""
    found = ((m.start(1), m.end(1), m[1]) for m in SEED.finditer(text))
    return [(s, SECRET, e) for s, e, v in found if re.search("[0-9]", v) and re.search("[A-Za-z]", v)]


def other_form(kind: int, value: str, n: int) -> str:
    """A known entity as somebody else may write it; the base patterns match none of these."""
    digits = NO_DIGIT.sub("", value)
    if kind == 0:
        return value.replace("@", ("(at)", "[at]", "[@]", "{at}")[n % 4])
    if kind == 1:
        return ("-", "[.]", "_", ":")[n % 4].join(value.split("."))
    if kind == 2:
        return (".", "/", "_", ":")[n % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3:
        local = digits[-10:]
        return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}/{local[3:6]}-{local[6:]}")[n % 4]
    return (value, f"<{value}>", f"({value})", f"[{value}]")[n % 4]


def near_miss(kind: int, value: str, n: int) -> str:
    """What looks like the entity and is none."""
    digits = NO_DIGIT.sub("", value) or "7"
    if kind == 0:
        return value.replace("@", ("-", "/", "_", ".")[n % 4])
    if kind == 1:
        return (f"{256 + n % 700}.{value.partition('.')[2]}", ".".join(value.split(".")[:2]), ".".join(value.split(".")[:3]), f"20{n % 90 + 10}-0{n % 9 + 1}-1{n % 10}")[n % 4]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + n % 9) % 10)
        return (wrong, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), digits[:9], ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)))[n % 4]
    if kind == 3:
        return (f"{digits[-4:]}", f"{digits[-5:-3]}-{digits[-3:]}", f"({digits[-3:]})", f"+{digits[-2:]}")[n % 4]
    return (f"v{n % 90}", f"{n % 100000}", f"item{n % 1000}", f"{n % 10}a")[n % 4]


def _base_labels(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """0, or 1 + the kind of the first span of ``base``, in the order of starts, that overlaps the node."""
    out, at = [], 0
    for s, e in spans:
        while at < len(base) and base[at][2] <= s:
            at += 1
        label, i = 0, at
        while i < len(base) and base[i][0] < e:
            if base[i][2] > s:
                label = 1 + base[i][1]
                break
            i += 1
        out.append(label)
    return out


def _columns(names: tuple[str, ...]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(n) % HASHED for n in names]


class Field:
    """Unary weights (HASHED x labels), bias, and pair potentials (2 x labels x labels), all as logarithms."""

    def __init__(self, w: np.ndarray, bias: np.ndarray, pair: np.ndarray):
        self.w, self.bias, self.pair = w, bias, pair

    def marginals(self, unary: np.ndarray, i: np.ndarray, j: np.ndarray, kind: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product over all edges at once; messages of one round are all sent together, half damped. ``doc`` numbers the
        document of each node: its messages stop once they settle, whatever other documents are in the batch."""
        if not len(i):
            return _softmax(unary)
        doc = np.zeros(len(unary), np.int64) if doc is None else doc
        src, dst = np.concatenate((i, j)), np.concatenate((j, i))
        pot = np.exp(np.concatenate((self.pair[kind], self.pair[kind].transpose(0, 2, 1))))
        back = np.concatenate((np.arange(len(i)) + len(i), np.arange(len(i))))
        message = np.zeros((len(src), unary.shape[1]))
        live = np.arange(len(src))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst[live], message[live])
            out = belief[src[live]] - message[back[live]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, pot[live]) + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            moved = np.zeros(doc.max() + 1)
            np.maximum.at(moved, doc[src[live]], np.abs(new - message[live]).max(axis=1))
            message[live] = 0.5 * message[live] + 0.5 * new
            live = live[moved[doc[src[live]]] > SETTLED]
            if not len(live):
                break
        belief = unary.copy()
        np.add.at(belief, dst, message)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(text: str, spans: list[tuple[int, int]], labels: list[int], only: list[bool] | None = None) -> Iterator[tuple[str, ...]]:
    """(label, left, right, same, similar, features): each node with the labels of its neighbours, ``-`` where there is none, and
    again without them. ``only`` picks nodes."""
    left, right, same, like = (["-"] * len(spans) for _ in range(4))
    for i, j, kind in chain(spans):
        left[j], right[i] = f"{kind}:{labels[i]}", f"{kind}:{labels[j]}"
    open_ = set()
    for held, groups in ((same, mentions(text, spans)), (like, similar(text, spans))):
        for g in groups:
            counts = Counter(labels[n] for n in g)
            for n in g:
                others = counts - Counter([labels[n]])
                entity = max((x for x in others if x), key=lambda x: (others[x], -x), default=0)
                held[n] = str(entity)
                # a token like a labelled one says nothing about what is no entity
                if entity and not labels[n] and held is same:
                    open_.add(n)
    # nor do the tokens beside it that are likely parts of the same mention
    for i, j, kind in (*chain(spans), *reversed(chain(spans))):
        if kind == NEAR and (i in open_ or j in open_):
            open_ |= {n for n in (i, j) if not labels[n]}
    for n, names in enumerate(features(text, spans)):
        if n not in open_ and (only is None or only[n]):
            yield (str(labels[n]), left[n], right[n], same[n], like[n], *names)
            yield (str(labels[n]), "-", "-", "-", "-", *names)
            if same[n] != "-" or like[n] != "-":
                # little is seen of the token itself: what other mentions are has to count
                yield (str(labels[n]), left[n], right[n], same[n], like[n], *[x for x in names if x[:2] in ("n:", "g:")])


def made_texts(text: str, known: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]], tuple[int, int]]]:
    """(text, spans, stretch of interest): other forms, alone and beside a clear mention, and near misses of known entities."""
    for s, kind, e in known[:8]:
        value = text[s:e]
        n = xxhash.xxh3_64_intdigest(value)
        lead, tail = text[max(0, s - 60) : s].rpartition("\n")[2], text[e : e + 60].partition("\n")[0]
        masked = re.sub(r"\S+[\s\"']*[=:]?[\s\"']*$", "", lead) if kind == SECRET else lead
        clear = f"{lead}{value}{tail}\n"
        for i in range(4):
            form, miss = other_form(kind, value, i), near_miss(kind, value, (n >> 8) * 4 + i)
            yield masked + form + tail, [(len(masked), kind, len(masked) + len(form))], (len(masked), len(masked) + len(form))
            yield lead + miss + tail, [], (len(lead), len(lead) + len(miss))
            at = len(clear) + len(masked)
            yield clear + masked + form + tail, [(len(lead), kind, len(lead) + len(value)), (at, kind, at + len(form))], (at, at + len(form))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> (key, n): how often each example occurs."""
    for batch in small(batches):
        seen: Counter = Counter()
        for text in batch.column("text").to_pylist():
            spans = nodes(text) if text else []
            if not spans:
                continue
            known = sorted([*base_spans(text), *seeds(text)])
            for x in examples(text, spans, _base_labels(spans, known)):
                seen["\x01".join(x)] += 1
            for made, labelled, (s, e) in made_texts(text, known):
                inner = nodes(made)
                for x in examples(made, inner, _base_labels(inner, sorted([*base_spans(made), *labelled])), [a < e and s < b for a, b in inner]):
                    seen["\x01".join(x)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["key", "n"])


def fit(got: list[tuple[list[str], int]], steps: int = 300, rate: float = 0.05, decay: float = 2e-5) -> Field | None:
    """Unary weights and pair potentials that maximise the pseudo-likelihood of counted examples, by Adam on all of them."""
    if not got:
        return None
    k = len(ALL_KINDS) + 1
    xs, ys, ns, before, behind = [], [], [], [], []
    for r, (x, n) in enumerate(got):
        y, left, right, same, like = x[:5]
        ys.append(int(y))
        ns.append(n)
        xs.append(_columns(tuple(x[5:])))
        if left != "-":
            before.append((r, *map(int, left.split(":"))))
        if right != "-":
            behind.append((r, *map(int, right.split(":"))))
        if same != "-":
            behind.append((r, SAME, int(same)))
        if like != "-":
            behind.append((r, SIMILAR, int(like)))
    weight = np.sqrt(np.array(ns, np.float64))  # very common tokens shall not drown the others
    weight /= weight.sum()
    row, col, y = np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs), np.eye(k)[ys]
    before, behind = (np.array(x, np.int64).reshape(-1, 3).T for x in (before, behind))
    p = [np.zeros((HASHED, k)), np.zeros(k), np.zeros((4, k, k))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, steps + 1):
        z = np.stack([np.bincount(row, p[0][col, c], len(xs)) for c in range(k)], axis=1)
        np.add.at(z, before[0], p[2][before[1], before[2]])
        np.add.at(z, behind[0], p[2].transpose(0, 2, 1)[behind[1], behind[2]])
        g = (_softmax(z + p[1]) - y) * weight[:, None]
        gw = np.stack([np.bincount(col, g[row, c], HASHED) for c in range(k)], axis=1)
        one, two = np.zeros((4, k, k)), np.zeros((4, k, k))
        np.add.at(one, (before[1], before[2]), g[before[0]])
        np.add.at(two, (behind[1], behind[2]), g[behind[0]])
        for i, gr in enumerate((gw + decay * p[0], g.sum(axis=0), one + two.transpose(0, 2, 1) + 10 * decay * p[2])):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr * gr
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Field(p[0], p[1], np.clip(p[2], -4, 4))


def train(docs: DataFrame, sample: int = SAMPLE) -> Field | None:
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` ids: small enough to be sent to all tasks
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    counted = rows.mapInArrow(_counts, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    got = counted.orderBy(F.col("n").desc(), "key").limit(EXAMPLES).collect()
    return fit([(r["key"].split("\x01"), r["n"]) for r in got])


def complete(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, in batches of ``BATCH_NODES`` nodes or so."""
    out, held, n = [], [], 0
    for t in texts:
        held.append(t)
        n += len(nodes(t)) if field is not None and NODE.search(t) else 0
        if n >= BATCH_NODES:
            out += _complete(held, field)
            held, n = [], 0
    return out + _complete(held, field)


def _complete(texts: list[str], field: Field | None) -> list[tuple[list, list]]:
    base = [base_spans(t) for t in texts]
    if field is None:
        return [(b, b) for b in base]
    spans = [nodes(t) for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(s) for s in spans])))
    if not starts[-1]:
        return [(b, b) for b in base]
    names = [f for t, s in zip(texts, spans, strict=True) for f in features(t, s)]
    cols = [_columns(f) for f in names]
    unary = np.tile(field.bias, (len(names), 1))
    np.add.at(unary, np.repeat(np.arange(len(cols)), [len(c) for c in cols]), field.w[np.concatenate(cols)])
    labels = [_base_labels(s, b) for s, b in zip(spans, base, strict=True)]
    links = [(at + i, at + j, kind) for at, s in zip(starts, spans, strict=False) for i, j, kind in chain(s)]
    hubs, hub_docs = [], []
    for n, (t, s) in enumerate(zip(texts, spans, strict=True)):
        for kind, groups in ((SAME, mentions(t, s)), (SIMILAR, similar(t, s))):
            for g in groups:
                links += [(starts[n] + m, len(names) + len(hubs), kind) for m in g]
                seen = np.bincount([labels[n][m] for m in g], minlength=unary.shape[1])
                seen[0] = 0
                # far below what any number of mentions adds up to; a hub of similar tokens is not observed
                observed = kind == SAME and seen.any()
                hubs.append(np.where(seen > 0, np.log(np.maximum(seen, 1) / max(seen.sum(), 1)), -1e7) if observed else np.zeros(unary.shape[1]))
                hub_docs.append(n)
    links = [x for x in links if x[2] < len(field.pair)]
    # nodes in base spans are known
    known = np.array([y for of in labels for y in of])
    unary[known > 0] -= 50.0
    unary[known > 0, known[known > 0]] += 50.0
    i, j, kind = np.array(links, np.int64).reshape(-1, 3).T
    doc = np.concatenate((np.repeat(np.arange(len(spans)), [len(s) for s in spans]), np.array(hub_docs, np.int64)))
    p = field.marginals(np.vstack((unary, *hubs)), i, j, kind, doc)[: len(names)]
    best = p.argmax(axis=1)
    sure = p.max(axis=1) >= SURE
    out = []
    for n, b in enumerate(base):
        found: list[list[int]] = []
        taken = labels[n]
        for at, (s, e) in enumerate(spans[n]):
            k = int(best[starts[n] + at])
            if k == 0 or not sure[starts[n] + at] or taken[at]:
                continue
            if found and found[-1][1] == k - 1 and s - found[-1][2] <= 1 and found[-1][3] == at - 1:
                found[-1][2:] = [e, at]
            else:
                found.append([s, k - 1, e, at])
        out.append((b, sorted([*b, *((s, k, e) for s, k, e, _ in found)])))
    return out


def find(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added, n_secret (of the field), and
    personal (whether there is any span)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(rows, sample))
    numbers = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            done = complete([t or "" for t in batch.column("text").to_pylist()], model.value)
            kinds = [Counter(k for _, k, _ in b) for b, _ in done]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *[pa.array([c[k] for c in kinds], pa.int64()) for k in range(len(KINDS))],
                    pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b, _ in done], pa.string()),
                    pa.array([digest(s) for _, s in done], pa.string()),
                    pa.array([len(s) - len(b) for b, s in done], pa.int64()),
                    pa.array([sum(k == SECRET for _, k, _ in s) for _, s in done], pa.int64()),
                    pa.array([bool(s) for _, s in done], pa.bool_()),
                ],
                ["doc_id", *numbers, "base_sha256", "spans", "n_added", "n_secret", "personal"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in numbers) + ", base_sha256 string, spans string, n_added long, n_secret long, personal boolean")
