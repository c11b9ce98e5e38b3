"""Personal data: rules for what has one form, and a linear-chain conditional random field for what has many.

The rules find e-mail addresses, network addresses, card and phone numbers. The field labels words by their shapes, those of
their neighbours and a few words that announce such data, so it also finds numbers without a country code, addresses
that are written out, and cards beside other digits. It is trained on a small labelled table by gradient ascent on the
likelihood (forward and backward sums), and labels texts by Viterbi in numpy batches. Only what overlaps no span of
the rules, and has the digits or the name that its kind needs, is added.

A span of any kind holds a digit, an @ or a written-out at, so the field reads islands: those places with NEAR words
on either side. Islands that meet are one; what is beyond the reach of its features cannot change a label.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from codeloom.llm.common import kept, map_rows

KINDS = ("email", "ip", "card", "phone")
#: O, then the first and the further words of each kind.
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
N = len(LABELS)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is looked at from its start alone, so that long ones take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+|[0-9]+|\S")
CUE = re.compile(r"[0-9@]|[(\[{<]\s?(?i:at)\s?[)\]}>]|\b(?i:at)\b(?=\s+[^\W_]+\s+(?i:dot)\b)")
#: Words on either side of an island, and the most words that are labelled as one sequence.
NEAR, LONGEST = 6, 400
#: Words that announce or are part of personal data; other words are told by their shape only.
TELLING = frozenset("at dot mail email e contact write tel phone call fax mobile mobil ip host server card visa com org net de fr es io".split())


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(number)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def byte_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the rules alone: by kind as in KINDS, then by start."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    out += [("ip", *m.span()) for m in IP.finditer(text) if byte_parts(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(n := digits(m.group())) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def sound(kind: str, text: str) -> bool:
    """Whether a span of the field has what its kind needs."""
    n = len(digits(text))
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits(text))
    if kind == "phone":
        return 7 <= n <= 15
    if kind == "ip":
        return text.count(".") == 3 and re.fullmatch("[0-9.]+", text) is not None and byte_parts(text)
    return re.search(r"[^\W_].*(@|\b(?i:at)\b).*[^\W_]", text) is not None and re.search(r"[^\W_]\s?(\.|\b(?i:dot)\b).*[^\W\d_]{2}\W*$", text) is not None


# Features


class Shapes(dict):
    """Words and whether a space is before them -> their shape, each worked out once."""

    def __missing__(self, key: tuple[str, bool]) -> str:
        word, spaced = key
        if word.isascii() and word.isdigit():
            n = len(word)
            shape = f"9{n if n <= 7 else 12 if n <= 12 else 19 if n <= 19 else 20}"
        elif word[0].isalpha():
            low = word.lower()
            shape = low if low in TELLING else ("a" if word == low else "A" if word[1:] == low[1:] else "AA") + str(min(len(word), 3))
        else:
            shape = word if word.isascii() else "#"
        if len(self) > 100_000:
            self.clear()
        self[key] = made = (" " if spaced else "") + shape
        return made


SHAPES = Shapes()


def shapes_of(text: str, words: list[tuple[int, int]]) -> list[str]:
    return [SHAPES[text[a:b], a > 0 and text[a - 1].isspace()] for a, b in words]


def features_of(shapes: list[str]) -> list[tuple[str, ...]]:
    """Of each word: its shape, those of two words before and after it, and what it makes with one or both neighbours."""
    s = ["^^", "^", *shapes, "$", "$$"]
    return [("0" + s[i], "-" + s[i - 1], "+" + s[i + 1], "=" + s[i - 2] + "|" + s[i - 1], "*" + s[i + 1] + "|" + s[i + 2], "<" + s[i - 1] + "|" + s[i], ">" + s[i] + "|" + s[i + 1], "~" + s[i - 1] + "|" + s[i] + "|" + s[i + 1]) for i in range(2, len(s) - 2)]


#: Features that hold the word's own shape; the others alone say little, and their weights are held down.
OWN = "0<>~"


def allowed() -> np.ndarray:
    """Which label may follow which: further words of a kind come after its first or further ones."""
    return np.array([[not b.startswith("I") or (a != "O" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])


# The field


@dataclass
class Field:
    known: dict[str, int]
    weights: np.ndarray  # features x labels
    follow: np.ndarray  # labels x labels; far under 0 where a label may not follow

    def potentials(self, sequences: list[list[tuple[str, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        """Padded scores (sequence, place, label) and lengths."""
        lengths = np.array([len(s) for s in sequences])
        get, none = self.known.get, len(self.known)
        ids = np.array([get(f, none) for s in sequences for word in s for f in word]).reshape(int(lengths.sum()), -1)
        flat = np.vstack([self.weights, np.zeros((1, N))])[ids].sum(axis=1)
        out = np.zeros((len(sequences), max(1, lengths.max(initial=0)), N))
        out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths])] = flat
        out[:, 0, [k for k in range(N) if LABELS[k][0] == "I"]] = -1e9  # nothing goes on at the start
        return out, lengths


def viterbi(scores: np.ndarray, lengths: np.ndarray, follow: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence of padded scores (sequence, place, label)."""
    b, t, _ = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((t, b, N), np.int8)
    for k in range(1, t):
        each = best[:, :, None] + follow
        back[k] = each.argmax(axis=1)
        now = each.max(axis=1) + scores[:, k]
        on = (k < lengths)[:, None]
        best = np.where(on, now, best)
        back[k] = np.where(on, back[k], np.arange(N))
    out = np.zeros((b, t), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        out[:, k - 1] = back[k, np.arange(b), out[:, k]]
    return [row[:n] for row, n in zip(out, lengths, strict=True)]


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, lengths: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of padded scores: the logarithm of each sequence's sum over all labellings, each place's label probabilities, and the
    expected number of each label after each other one, over all sequences."""
    b, t, _ = scores.shape
    ahead, behind = np.zeros((t, b, N)), np.zeros((t, b, N))
    ahead[0] = scores[:, 0]
    for k in range(1, t):
        ahead[k] = np.where((k < lengths)[:, None], log_sum(ahead[k - 1][:, :, None] + follow, 1) + scores[:, k], ahead[k - 1])
    for k in range(t - 2, -1, -1):
        behind[k] = np.where((k + 1 < lengths)[:, None], log_sum(follow + (scores[:, k + 1] + behind[k + 1])[:, None, :], 2), behind[k + 1])
    total = log_sum(ahead[-1], 1)
    p = np.exp(ahead + behind - total[:, None]).transpose(1, 0, 2)
    pairs = np.zeros((N, N))
    for k in range(1, t):
        on = k < lengths
        pairs += np.exp(ahead[k - 1][on][:, :, None] + follow + (scores[:, k] + behind[k])[on][:, None, :] - total[on][:, None, None]).sum(axis=0)
    return total, p * (np.arange(t) < lengths[:, None])[:, :, None], pairs


def labels_of(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """The labels of words (start, end) by spans (kind, start, end)."""
    out = [0] * len(words)
    for kind, start, end in spans:
        inside = [i for i, (a, b) in enumerate(words) if a < end and b > start]
        for k, i in enumerate(inside):
            out[i] = LABELS.index(("I-" if k else "B-") + kind)
    return out


def fit(labelled: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 120, penalty: float = 0.01, rate: float = 0.2) -> Field:
    """The field for labelled texts (text, spans), by gradient ascent with a step of its own for each weight."""
    field = Field({}, np.zeros((0, N)), np.where(allowed(), 0.0, -1e9))
    words = [[m.span() for m in WORD.finditer(t)] for t, _ in labelled]
    sequences = [features_of(shapes_of(t, w)) for (t, _), w in zip(labelled, words, strict=True)]
    truth = [labels_of(w, s) for w, (_, s) in zip(words, labelled, strict=True)]
    some = [i for i, w in enumerate(words) if w]
    sequences, truth = [sequences[i] for i in some], [truth[i] for i in some]
    for s in sequences:
        for word in s:
            for f in word:
                field.known.setdefault(f, len(field.known))
    field.weights = np.zeros((len(field.known), N))
    if not sequences:
        return field
    ids = np.array([field.known[f] for s in sequences for word in s for f in word]).reshape(-1, len(sequences[0][0]))
    flat = np.concatenate([np.array(t) for t in truth])
    seen = np.zeros((N, N))
    for t in truth:
        np.add.at(seen, (t[:-1], t[1:]), 1)
    prior = np.array([[penalty * (1 if f[0] in OWN else 50)] for f in field.known])
    speed, speed_follow = np.full_like(field.weights, 1e-6), np.full((N, N), 1e-6)
    for _ in range(rounds):
        scores, lengths = field.potentials(sequences)
        _, p, pairs = marginals(scores, lengths, field.follow)
        short = np.eye(N)[flat] - p[np.arange(p.shape[1]) < lengths[:, None]]
        each = np.repeat(short, ids.shape[1], axis=0)
        g = np.stack([np.bincount(ids.ravel(), weights=each[:, k], minlength=len(field.known)) for k in range(N)], axis=1) - prior * field.weights
        speed += g * g
        field.weights += rate * g / np.sqrt(speed)
        h = np.where(allowed(), seen - pairs - penalty * np.where(allowed(), field.follow, 0), 0)
        speed_follow += h * h
        field.follow += rate * h / np.sqrt(speed_follow)
    return field


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) around each cue of the text, those of cues that meet together."""
    found = [m.start() for m in CUE.finditer(text)]
    out, k = [], 0
    while k < len(found):
        # NEAR words before the first cue; words are read on until NEAR of them have no cue.
        start = found[k]
        for _ in range(NEAR):
            start = before(text, start)
        words, left, at = [], NEAR, start
        while left >= 0 and len(words) < LONGEST:
            m = WORD.search(text, at)
            if m is None:
                break
            at = m.end()
            words.append(m.span())
            if k < len(found) and found[k] < at:
                left = NEAR
                while k < len(found) and found[k] < at:
                    k += 1
            elif m.start() > found[k - 1]:
                left -= 1
        out.append(words)
    return out


def before(text: str, at: int) -> int:
    """Where the word before a place starts, not more than 40 characters away from its end."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    end = at
    while at > 0 and end - at < 40 and text[at - 1].isalpha():
        at -= 1
    return at if at < end or at == 0 else at - 1


def field_spans(texts: list[str], field: Field, cells: int = 100_000) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) that the field finds in each text, by start."""
    found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    all_ = [(i, words) for i, t in enumerate(texts) for words in islands(t)]
    all_.sort(key=lambda x: len(x[1]))  # sequences of like lengths share a matrix
    at = 0
    while at < len(all_):
        end = at + max(1, cells // max(1, len(all_[min(len(all_) - 1, at + 63)][1])))
        part = all_[at:end]
        scores, lengths = field.potentials([features_of(shapes_of(texts[i], words)) for i, words in part])
        for (i, words), labels in zip(part, viterbi(scores, lengths, field.follow), strict=True):
            for k in np.flatnonzero(labels):
                kind = LABELS[labels[k]][2:]
                if LABELS[labels[k]][0] == "B":
                    found[i].append((kind, *words[k]))
                else:
                    found[i][-1] = (kind, found[i][-1][1], words[k][1])
        at = end
    return [sorted(set(s), key=lambda x: (x[1], x[2])) for s in found]


def added(text: str, base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """base and those of more that meet no span before them and are sound, by kind as in KINDS and then by start."""
    out, taken = list(base), sorted((a, b) for _, a, b in base)
    last = 0
    for kind, a, b in more:
        if a >= last and not any(x < b and y > a for x, y in taken) and sound(kind, text[a:b]):
            out.append((kind, a, b))
            last = b
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def find(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns in keep, the number of each kind by the rules, their digest, and all spans, of every row's whole text.

    spans: kind:start:end in code points, end exclusive, by kind and start, joined by commas. A null text is empty; rows that
    repeat fare alike; of keep, a column with the name of one that is made here is left out. Texts of any length are read
    whole, in linear time.
    """
    spark, keep = docs.sparkSession, kept(keep, FOUND)
    sent = spark.sparkContext.broadcast(field)
    schema = docs.select(*keep).schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"])

    def rows(columns):
        texts = [t or "" for t in columns[-1]]
        base = [rule_spans(t) for t in texts]
        every = [added(t, b, m) for t, b, m in zip(texts, base, field_spans(texts, sent.value), strict=True)]
        counts = [[sum(s[0] == kind for s in b) for b in base] for kind in KINDS]
        yield [*columns[:-1], *counts, [hashlib.sha256(told(b).encode()).hexdigest() for b in base], [told(s) for s in every]]

    return map_rows(docs.select(*keep, _text(docs)), rows, ddl)


def _text(docs: DataFrame):
    return docs["text"].alias("__text")


def masked(text: str, spans: str) -> str:
    """The text with each of its spans as <kind>; of spans that overlap, the first stands.

    >>> masked("call +1 (407) 555-7710 now", "phone:5:22")
    'call <phone> now'
    """
    parsed = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, k in parsed:
        if a >= at:
            out += [text[at:a], f"<{k}>"]
            at = b
    return "".join([*out, text[at:]])


# The labelled table

#: How each kind is written: # is a digit, w a word, d a domain's end; and numbers that are no personal data.
FORMS = {
    "email": ["w.w@w.d", "w##@w#.w.d", "w_w (at) w.d", "w [at] w.d", "w at w dot d", "w.w (at) w (dot) d", "w@w [dot] d", "w@w.w.d", "w-w+w@w.d", "w.##@w#.w.d", "w.##@w#.d", "w.##@w.d", "w.w@w.w.d", "w##@w.d"],
    "ip": ["##.##.##.##", "###.##.#.###", "###.###.###.###", "#.#.#.#"],
    "card": ["################", "#### #### #### ####", "####-####-####-####", "#### ###### #####", "####.####.####.####"],
    "phone": ["+# (###) ###-####", "+## ### ######", "+##-###-###-####", "(###) ###-####", "###-###-####", "###.###.####", "+## (#) ### ######", "+############"],
    "O": ["##", "####", "##.##.####", "####-##-##", "##:##", "##:##:##", "##.##", "#,###", "$##.##", "#.#.#", "##%", "####-####", "## ##", "w##", "# w # w", "###", "#####", "######", "## at ##", "w at w", "@w", "########", "##/##/####", "token = \"x\"", "v#.#.#", "###w###w##", "(####)", "########################", "w@", "#-#", "+#"],
}
#: What stands around them; %s is the place.
AROUND = ["w w %s w w.", "%s w w", "W w w %s", "w: %s, w w", "w w (%s) w", "W %s w w %s w", "mail %s w w", "tel. %s or w", "w | %s | w", "call %s w.", "server %s w w", "card %s, w", "w w.\nW %s w", "\"%s\" w w", "w%s w w", "### %s w", "%s w %s w %s"]
LETTERS, ENDS = "aeioubdfgklmnprstvz", ("com", "org", "net", "de", "fr", "es", "io", "example.com")


def table(rows: int = 700, seed: int = 13) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table of texts and their spans, made of FORMS and AROUND; equal arguments give an equal table."""
    rng = random.Random(seed)

    def word(capital: bool = False) -> str:
        made = "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 11)))
        return made.capitalize() if capital or rng.random() < 0.1 else made

    def filled(form: str) -> str:
        say = {"#": lambda: str(rng.randint(0, 9)), "x": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(24)), "d": lambda: rng.choice(ENDS), "w": word}
        alone = re.compile(r"#|(?<![a-z])[xdw](?![a-z])")
        return alone.sub(lambda m: say[m.group()](), form)

    out = []
    for _ in range(rows):
        text, spans = "", []
        for k, part in enumerate(re.split("(%s)", re.sub(r"(?<![A-Za-z%])[wW](?![A-Za-z])|(?<![A-Za-z])w(?=%s)", lambda m: word(m.group() == "W"), rng.choice(AROUND)))):
            if k % 2:
                kind = rng.choice([*KINDS, "O", "O", "O"])
                value = filled(rng.choice(FORMS[kind]))
                if kind == "ip":
                    value = ".".join(str(int(p) % 256) for p in value.split("."))
                if kind != "O":
                    if text[-1:].isalnum() or text.endswith("+"):
                        text += " "
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += part
        out.append((text, spans))
    return out
