import math
import re
from collections import Counter

import numpy as np
import pytest

from crossbasket.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, repeated, len(covered), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_brute_force_on_awkward_rows(awkward, nothing):
    rows = quality.report(awkward).collect()
    got = sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in rows), key=str)
    assert got == sorted(((r["doc_id"], *base(r["text"])) for r in awkward.collect()), key=str)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.report(nothing).collect() == []


def plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney, with dictionaries."""
    tri = Counter()
    for text in texts:
        x = [0, 0, *[0 if ord(c) < 0x3002 and quality._WHITE[ord(c)] else ord(c) + 1 for c in text], 0]
        tri.update(zip(x, x[1:], x[2:]))
    bi = Counter(g[1:] for g in tri)
    uni = Counter(g[1:] for g in bi)

    def level(grams, lower):
        n = [sum(v == i for v in grams.values()) for i in range(1, 5)]
        if min(n):
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]
        else:
            d = [0.5] * 3
        total, taken = Counter(), Counter()
        for g, v in grams.items():
            total[g[:-1]] += v
            taken[g[:-1]] += d[min(v, 3) - 1]
        return {
            g: (v - d[min(v, 3) - 1]) / total[g[:-1]] + taken[g[:-1]] / total[g[:-1]] * lower[g[1:]] for g, v in grams.items()
        }

    return level(tri, level(bi, level(uni, {(): 1 / len(uni)})))


def test_models_equal_plain_kneser_ney(spark):
    rows = [("the cat sat on the mat", "en"), ("a cat, a hat\x00é", "en"), ("", "en"), (None, "en"), ("Ψδ 漢字漢 😀", "el"), ("x", None)]
    rows += [(" ".join("abcdefgh"[i * j % 8] * (i % 3 + 1) for j in range(20)), "en") for i in range(40)]
    documents = spark.createDataFrame(rows, "text string, lang string")
    got = {(r["lang"], r["gram"]): r["p"] for r in quality.language_models(documents).collect()}
    expected = {}
    for lang in {lang for _, lang in rows}:
        for (a, b, c), p in plain_kneser_ney([t or "" for t, x in rows if x == lang]).items():
            expected[lang or "", a << 42 | b << 21 | c] = p
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(p, rel=1e-9) for k, p in expected.items())


def plain_verdicts(rows):
    """``perplexity`` and ``kept`` of each (text, lang), in plain Python."""
    own = {lang or "" for _, lang in rows}
    models = {name: plain_kneser_ney([t or "" for t, lang in rows if (lang or "") == name]) for name in own}

    def measured(text, lang):
        x = [0, 0, *[0 if ord(c) < 0x3002 and quality._WHITE[ord(c)] else ord(c) + 1 for c in text or ""], 0]
        log_p = [math.log(models[lang or ""][g]) for g in zip(x, x[1:], x[2:])]
        n = max(1, len(log_p) // quality.WINDOW_POINTS)
        cuts = [len(log_p) * i // n for i in range(n + 1)]
        means = sorted(sum(log_p[a:b]) / (b - a) for a, b in zip(cuts, cuts[1:]))
        return (means[(n - 1) // 2] + means[n // 2]) / 2, means[n // 4], len(log_p)

    found = [measured(*row) for row in rows]

    def quartiles(lang, which):
        texts = {t or "": f[which] for (t, own_lang), f in zip(rows, found) if (own_lang or "") == lang and not base(t)[-1]}
        values = sorted(texts.values())
        return [values[math.ceil(len(values) * q) - 1] for q in (0.25, 0.5, 0.75)] if values else None

    limits = {lang: (quartiles(lang, 0), quartiles(lang, 1)) for lang in own}
    out = []
    for (text, lang), (median, low, n) in zip(rows, found):
        q, l = limits[lang or ""]
        kept = not base(text)[-1]
        if kept:
            more = quality.NOISE / math.sqrt(n)
            kept = abs(median - q[1]) <= quality.SPREAD * (q[2] - q[0]) + more
            kept = kept and low >= l[1] - quality.LOW_SPREAD * (l[2] - l[0]) - 2 * more
        out.append((math.exp(-median), kept))
    return out


def test_verdicts_equal_brute_force(spark):
    """Perplexities, bands and verdicts, with copies, junk, scrambled texts, null languages and odd rows."""
    rng = np.random.default_rng(11)

    def clean(words):
        return " ".join(" ".join(rng.permutation(words)) for _ in range(rng.integers(1, 9)))

    rows = []
    for lang, words in [*SCRIPTS.items(), (None, "time river stone under light morning carry window garden silver".split())]:
        good = [clean(words) for _ in range(50)]
        rows += [(text, lang) for text in good + good[:5]]
        rows += [("".join(rng.permutation(list(text))), lang) for text in good[:6]]
        rows += [(good[i] + " " + "".join(rng.permutation(list(good[i + 1]))), lang) for i in range(6)]
        rows += [("%$ " * 40, lang), (" ".join(words[:9]), lang), ("", lang), (None, lang), (words[0] * 200, lang)]
    rows.append(("only text of its language and much too short", "xx"))
    documents = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["perplexity"], r["kept"]) for r in quality.report(documents.repartition(5)).collect()}
    expected = dict(enumerate(plain_verdicts(rows)))
    assert {i: v[1] for i, v in got.items()} == {i: v[1] for i, v in expected.items()}
    assert all(got[i][0] == pytest.approx(p, rel=1e-4) for i, (p, _) in expected.items())
    assert 100 < sum(v[1] for v in got.values()) < len(rows) - 30


def test_shards_of_the_models_change_nothing(awkward):
    models = quality.language_models(awkward)
    assert models.count() > 100

    def rows(entries):
        found = quality.measure(awkward, models, ("doc_id", "label"), entries).collect()
        return sorted(((r["row"], [round(x, 6) if isinstance(x, float) else x for x in r["quality"]]) for r in found), key=str)

    assert rows(1 << 20) == rows(models.count() // 3)


def test_quantiles_of_windows():
    starts = np.array([0, 1200, 1201, 1501])
    low, high, n = quality.windows(starts)
    assert n.tolist() == [12, 1, 3] and low[0] == 0 and high[-1] == 1501 and (high[:-1] == low[1:]).all()
    means = np.array([-1.0] * 9 + [-9.0] * 3 + [-2.0] + [-3.0, -4.0, -5.0])
    median, quartile = quality.window_quantiles(means, n)
    assert median.tolist() == [-1.0, -2.0, -4.0] and quartile.tolist() == [-1.0, -2.0, -5.0]
    means[8] = -9.0  # more than a quarter is bad
    assert quality.window_quantiles(means, n)[1][0] == -9.0


def test_lines_made_to_collide_are_different(spark):
    lines = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(4096)) for k in (0, 1)]
    documents = spark.createDataFrame([(1, "\n".join(lines), "en"), (2, "\n".join(lines * 2), "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.report(documents).collect()} == {1: 0, 2: 2}


SCRIPTS = {
    "ja": "これ は 日本 語 の 文章 です 東京 大阪 山川 天気 今日 明日 学校 先生 生徒 本を 読む 書く 話す".split(),
    "ru": "время река камень под светом утро нести окно сад серебро дорога город человек слово".split(),
    "el": "χρόνος ποτάμι πέτρα κάτω φως πρωί φέρω παράθυρο κήπος ασήμι δρόμος πόλη λόγος".split(),
}


def test_scrambled_texts_of_all_scripts_are_rejected(spark):
    """Also where a source of junk, a third of all rows, repeats one text and fails the base rules otherwise."""
    rng = np.random.default_rng(5)
    rows, bad = [], set()

    def clean(words):
        return " ".join(" ".join(rng.permutation(words)) for _ in range(5))

    for lang, words in SCRIPTS.items():
        rows += [(len(rows) + i, clean(words), lang) for i in range(120)]
        for _ in range(8):
            bad.add(len(rows))
            rows.append((len(rows), "".join(rng.permutation(list(clean(words)))), lang))
        for i in range(64):
            bad.add(len(rows))
            rows.append((len(rows), "%$ " * 40 if i % 2 else "|# " + " ".join(str(x) for x in range(3)), lang))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.report(documents).collect()}
    assert not any(kept[i] for i in bad)
    assert np.mean([v for i, v in kept.items() if i not in bad]) > 0.97
    assert {r["doc_id"] for r in quality.kept_rows(documents).collect()} == {i for i, v in kept.items() if v}


def test_as_many_models_as_languages(spark):
    rows = [(i, f"{'abcdefgh'[i % 8]}x y{i % 7} " * 12, f"l{i % 70}") for i in range(140)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality.language_models(documents).select("lang").distinct().count() == 70


def test_scrambled_text_is_rejected_and_clean_text_kept(spark):
    rng = np.random.default_rng(3)
    words = ["time", "river", "stone", "under", "light", "morning", "carry", "window", "garden", "silver"]

    def clean():
        return " ".join(f"{a} {b}s" for a, b in zip(rng.permutation(words), rng.permutation(words)))

    rows = [(i, "\n".join(clean() for _ in range(4)), "en") for i in range(300)]
    rows += [(1000 + i, "".join(rng.permutation(list(clean() * 4))), "en") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.report(df).filter("not base_failed").collect()}
    assert np.mean([v for k, v in kept.items() if k < 1000]) > 0.97
    assert not any(v for k, v in kept.items() if k >= 1000)
