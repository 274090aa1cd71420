import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.shipping import ship

#: Another generator than that of the training: English sentences, names and formats of its own.
NAMES = "alice bob carol johnson miller garcia smith dubois muller okafor tanaka ivanova rossi silva kowalski nguyen".split()
HOSTS = ["gmail.com", "yahoo.co.uk", "uni-bonn.de", "mail.net", "acme.io", "city.gov", "post.ch", "web3.dev"]
FRAMES = [
    "Please contact {} before Friday.", "You can reach me via {} or at the office.", "My details: {}; thanks!", "She wrote to {}, who never answered.", "Reply to {} and attach the report of 2023-04-17.",
    "Customer no. 48213 left this: {}. Ticket #5521 is closed.", "the old entry {} was removed in version 2.14.1 at 10:45", "Send {} to the front desk, room 204, by 12/05/2024.",
]
PLAIN = [
    "We met at noon and paid $12.50 for 2 tickets.", "Version 10.2.33 was built on 2022-11-30 at 08:15:22.", "See pages 112-118, figure 3.4 and table 12.", "ISBN 978-0-306-40615-7 costs 24.99 dollars.", "He lives at 221 Baker Street and left at 9.",
    "The commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b fixed it.", "It rose from 1,204,331 to 1,530,007 between 1999 and 2004.", "Look at the dot on the map, at row 17.", "Set timeout=3000 and retries: 5 at most.", "@sandra liked this at 23:59.",
]


def card(rng):
    d = rng.choice(["4", "5"]) + "".join(rng.choices("0123456789", k=14))
    return d + next(c for c in "0123456789" if pii.luhn(d + c))


def planted(rng, kind):
    """A span that the patterns miss."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    if kind == "email":
        who, host = rng.choice(NAMES) + rng.choice([".", "_", ""]) + rng.choice([*NAMES, ""]) + rng.choice(["", "", "7", "84"]), rng.choice(HOSTS)
        who = who.rstrip("._")
        return rng.choice([f"{who} (at) {host}", f"{who}[at]{host}", f"{who} [at] {host}", f"{who}(at){host}", f"{who} at {host.replace('.', ' dot ')}", f"{who} @ {host}"])
    if kind == "ip":
        return rng.choice(["[.]", "[.]", " . "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        d = card(rng)
        return rng.choice([".", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))
    return rng.choice([f"{n(3)}-{n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}", f"00{n(2)} {n(3)} {n(3)} {n(4)}"])


@pytest.fixture(scope="module")
def tagger(spark):
    ship(spark)
    return pii.trained(spark)


def scored(tagger, seed, each=150):
    rng, texts, want = random.Random(seed), [], []
    for kind in pii.KINDS:
        for _ in range(each):
            s = planted(rng, kind)
            before = " ".join(rng.choices(PLAIN, k=rng.randrange(5)))
            frame = rng.choice(FRAMES)
            head, tail = frame.split("{}")
            texts.append(f"{before} {head}{s}{tail} {' '.join(rng.choices(PLAIN, k=rng.randrange(4)))}")
            want.append({(len(before) + 1 + len(head), pii.KINDS.index(kind), len(before) + 1 + len(head) + len(s))})
    right, missed, wrong = Counter(), Counter(), Counter()
    for text, spans, (base, every) in zip(texts, want, pii.find(texts, tagger), strict=True):
        added = set(every) - set(base)
        for s in spans | added:
            (right if s in spans and s in added else missed if s in spans else wrong)[pii.KINDS[s[1]]] += 1
    return {k: (right[k] / max(1, right[k] + wrong[k]), right[k] / (right[k] + missed[k])) for k in pii.KINDS}


def test_added_spans_of_another_generator(tagger):
    got = scored(tagger, 1)
    assert all(precision > 0.9 and recall > 0.9 for precision, recall in got.values()), got


def test_plain_sentences_get_no_spans(tagger):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(PLAIN, k=8)) for _ in range(200)]
    assert sum(len(every) for _, every in pii.find(texts, tagger)) == 0


def test_addresses_without_digit_or_sign_far_into_a_text(tagger):
    texts = [f"{'ton les mira ' * k}helenx (at) mail.net lo derus" for k in range(0, 60)]
    found = [any("(at)" in t[a:b] for a, r, b in every if r == 0) for t, (_, every) in zip(texts, pii.find(texts, tagger), strict=True)]
    assert np.mean(found) > 0.95


def test_windows_known_to_be_outside_equal_the_whole_search(tagger):
    rng = random.Random(4)
    texts = ["", "x", *("".join(rng.choices("ab é1.2@-+() \nat[]", k=rng.randrange(900))) for _ in range(60))]
    texts += [" ".join(planted(rng, rng.choice(pii.KINDS)) if rng.random() < 0.1 else rng.choice(PLAIN) for _ in range(rng.randrange(30))) for _ in range(60)]
    for a, b in zip(pii.tag_texts(tagger, texts), pii.tag_texts(tagger, texts, every=True), strict=True):
        assert (a == b).all()


def test_fast_emissions_and_viterbi_equal_plain_ones(tagger):
    chars, _ = pii.sentences(9, 20, 40)
    u = tagger.emissions(chars)
    assert np.allclose(u.transpose(0, 2, 1), tagger.fast_emissions(chars), atol=1e-3)
    small = u[:4, :5].astype(np.float64)
    tags = tagger.viterbi(chars[:5], every=True)
    weigh = lambda u, y: sum(u[t, k] for t, k in enumerate(y)) + sum(tagger.p["trans"][a, b] for a, b in zip(y, y[1:]))
    whole = u[:, :5]
    for i in range(5):
        best = weigh(whole[:, i], tags[i])
        for t in range(len(whole)):
            for k in range(whole.shape[2]):  # no single change is better
                y = list(tags[i])
                y[t] = k
                assert weigh(whole[:, i], y) <= best + 1e-3
    assert small.shape == (4, 5, 9)


class Counting(pii.Tagger):
    """A tagger that counts the characters that its directions run over."""

    run = 0

    def _direction(self, d, at, counts, u, ended):
        self.run += int(counts.sum()) if len(at) > 1 else 0
        return super()._direction(d, at, counts, u, ended)


def test_network_runs_over_texts_and_not_over_what_pads_them(tagger):
    counting = Counting()
    counting.p = tagger.p
    texts = [("ab 12 " * 100)[:k] for k in range(1, 500, 3)]
    pii.tag_texts(counting, texts)
    assert 2 * sum(map(len, texts)) <= counting.run <= 2.2 * sum(map(len, texts))


def test_emissions_to_the_ends_equal_those_of_padded_windows(tagger):
    rng = random.Random(7)
    texts = sorted(("".join(rng.choices("ab é1.2@-+() \nat[]", k=rng.randrange(1, 200))) for _ in range(40)), key=len, reverse=True)
    chars = np.stack([np.pad(pii.codes(t), (0, 200 - len(t))) for t in texts])
    u, cut = tagger.emissions(chars), tagger.fast_emissions(chars, np.array([len(t) for t in texts]))
    for i, t in enumerate(texts):
        assert np.allclose(u[: len(t), i], cut[: len(t), :, i], atol=1e-3)


def test_tags_do_not_depend_on_the_texts_beside(tagger):
    rng = random.Random(8)
    texts = ["", *(" ".join(planted(rng, rng.choice(pii.KINDS)) if rng.random() < 0.2 else rng.choice(PLAIN) for _ in range(rng.randrange(1, 30))) for _ in range(40))]
    for text, tags in zip(texts, pii.tag_texts(tagger, texts * 3), strict=False):
        assert (tags == pii.tag_texts(tagger, [text])[0]).all()


def test_reconciled_tags_come_from_the_nearest_middle(tagger):
    text = " ".join(f"{planted(random.Random(i), 'phone')} word{i}" for i in range(60))
    tags, c = pii.tag_texts(tagger, [text], every=True)[0], pii.codes(text)
    starts = range(0, max(1, len(c) - pii.MARGIN), pii.STRIDE)
    padded = np.pad(c, (0, pii.WINDOW))
    alone = {s: tagger.viterbi(padded[None, s : s + pii.WINDOW], every=True)[0] for s in starts}
    for i in range(len(c)):
        inside = [s for s in starts if s <= i < s + pii.WINDOW]
        nearest = min(inside, key=lambda s: abs(i + 0.5 - s - pii.WINDOW / 2))
        assert tags[i] == alone[nearest][i - nearest]


def test_spans_apart_from_base():
    rng = random.Random(5)
    for _ in range(200):
        spans = lambda: sorted({(a, 0, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(6))})
        added, base = spans(), spans()
        assert pii.apart(added, base) == [s for s in added if not any(s[0] < b[2] and b[0] < s[2] for b in base)]


def test_crf_gradients_are_right():
    g = pii.Tagger(1)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    g.p["trans"] += np.random.default_rng(0).normal(0, 0.3, g.p["trans"].shape)
    chars, tags = pii.sentences(2, 3, 12)
    _, grad = g.step(chars, tags)
    for k in ("trans", "out", "xf", "hb", "cf", "emb"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        old, e = g.p[k][at], 1e-3
        g.p[k][at] = old + e
        up = g.step(chars, tags)[0]
        g.p[k][at] = old - e
        down = g.step(chars, tags)[0]
        g.p[k][at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * e), rel=0.02, abs=1e-4)


def test_repeats_and_crc_of_training_are_the_same():
    a, b = pii.sentences(3, 4, 50), pii.sentences(3, 4, 50)
    assert zlib.crc32(a[0].tobytes()) == zlib.crc32(b[0].tobytes()) and (a[1] == b[1]).all()


def test_viterbi_is_the_best_path():
    g = pii.Tagger(3)
    g.p["trans"] = np.random.default_rng(1).normal(0, 1, g.p["trans"].shape).astype(np.float32)
    chars, _ = pii.sentences(4, 1, 4)
    u, a = g.emissions(chars)[:, 0], g.p["trans"]
    score = lambda p: sum(u[t, k] for t, k in enumerate(p)) + sum(a[i, j] for i, j in itertools.pairwise(p))
    best = max(itertools.product(range(u.shape[1]), repeat=4), key=score)
    assert tuple(g.viterbi(chars, every=True)[0]) == best


def test_patterns_equal_regular_expressions(spark):

    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    n = lambda m: sum("0" <= c <= "9" for c in m[0])
    tests = [lambda m: True, lambda m: all(len(x) < 9 and int(x) <= 255 for x in m[0].split(".")), lambda m: 12 <= n(m) <= 19 and pii.luhn(re.sub("[ -]", "", m[0])), lambda m: 9 <= n(m) <= 15]
    rng = random.Random(5)
    texts = ["".join(rng.choice("a@.-+1 2(34)5%6b7é") for _ in range(rng.randrange(70))) for _ in range(4000)] + ["4417123456789113 4417-1234-5678-9113", "1" * 5000 + ".1.1.1", "a" * 50_000 + "@" + "b" * 50_000 + ".c"]
    for t in texts[:-1]:
        assert pii.base_spans(t) == sorted((m.start(), k, m.end()) for k, p in enumerate(forms) for m in re.finditer(p, t) if tests[k](m))
    assert pii.base_spans(texts[-1]) == [(0, 0, len(texts[-1]))]
    df = spark.createDataFrame([(1, None), (2, ""), (None, "x@y.z"), (1, "+1 (415) 555-2671")], "doc_id long, text string").withColumn("base", F.lit(1))
    got = [(r.doc_id, len(r.base), len(r.spans)) for r in pii.detect(df).collect()]
    assert Counter(got) == Counter([(1, 0, 0), (2, 0, 0), (None, 1, 1), (1, 1, 1)])
    assert pii.detect(df.limit(0)).count() == 0
