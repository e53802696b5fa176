import math
import random

import numpy as np
import pytest

from loamdex.llm import leaks as L
from loamdex.llm import mixing as M
from loamdex.llm import pieces as P
from loamdex.llm import spam as S

PIECE = "id long, content string, start_byte long, indexed_at timestamp, piece int, token_count int, end_byte long"


def test_cut_tiles_and_stays_under_the_limit():
    rng = random.Random(1)
    alphabet = ["def f(x):\n", "    return x\n", "\n", "ünïcödé 深号 word; ", "x = [1, 2, 3]\r\n", "🙂", "a" * 70, "{", "}\n", "plain words here, and more. "]
    for n in (1, 20, 200, 800):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        raw = text.encode()
        for limit, over in ((1500, 150), (64, 20), (16, 0)):
            out = P.cut(text, limit, over)
            assert b"".join(raw[s + o : e] for s, e, o in out) == raw
            for k, (s, e, o) in enumerate(out):
                assert e - s <= limit and o <= over and (k or o == 0)
                raw[s:e].decode()  # no character is cut
            assert all(a[1] - b[2] == b[0] for a, b in zip(out, out[1:]))


def test_cut_prefers_functions():
    fn = "def f{0}(a):\n" + "    total = a + {0}\n" * 12 + "    return total\n\n"
    text = "".join(fn.format(i) for i in range(12))
    raw = text.encode()
    starts = [raw[s + o : s + o + 3] for s, _, o in P.cut(text, 600, 0)]
    assert all(x == b"def" for x in starts)
    with pytest.raises(ValueError):
        P.cut("x" * 100, 4)


def test_pieces_edges(spark):
    big, long_line = "word other\n" * 200, "x" * 40_000
    rows = [(1, big, 10, None, 0, 0, 0)] * 3 + [(2, "short", 0, None, 0, 0, 0), (3, None, 0, None, 0, 0, 0), (4, "", 0, None, 0, 0, 0), (5, long_line, None, None, 0, 0, 0), (None, big, 0, None, 0, 0, 0)]
    got = P.pieces(spark.createDataFrame(rows, PIECE)).orderBy("id", "piece").collect()
    assert {r["id"] for r in got} == {None, 1, 5}
    one = [r for r in got if r["id"] == 1]
    assert one[0]["start_byte"] == 10 and one[-1]["end_byte"] == 10 + len(big)
    assert all(r["token_count"] == len(r["content"].split()) and len(r["content"].encode()) <= 1500 for r in got)
    assert len([r for r in got if r["id"] == 5]) >= 27
    assert P.pieces(spark.createDataFrame([], PIECE)).count() == 0


ITEM = "item_id long, task string, item_text string, doc_id long"
DOC = "doc_id long, text string, source string, share double, item_id long, score double"


def sentences(rng, n):
    v = [f"w{i}" for i in range(400)]
    return [" ".join(rng.choice(v) for _ in range(rng.randint(8, 14))) + "." for _ in range(n)]


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    intro = "Answer the question using only these files. "
    items = [intro + " ".join(sentences(rng, rng.randint(6, 20))) for _ in range(12)]
    filler = lambda n: " ".join(sentences(rng, n))
    docs, want = [], set()
    for i, it in enumerate(items):
        w = it[len(intro) :].split()
        for share, leak in ((1.0, True), (0.5, True), (0.36, True), (0.2, False)):
            part = w[: int(len(w) * share)]
            changed = [f"new{k}" if k % 9 == 8 else x.upper() for k, x in enumerate(part)]
            text = filler(15) + "\n> " + " ".join(changed[:40]) + "\n> " + " ".join(changed[40:]) + "\n" + filler(15)
            if share == 0.5:
                text = '{"a": "' + " ".join(part).replace(" ", "\\n") + '"}'
            docs.append((len(docs), text, "s", 0.0, 1, 0.0))
            if leak:
                want.add((len(docs) - 1, i))
        docs.append((len(docs), intro + filler(10), "s", 0.0, 1, 0.0))
    docs += [(900, None, "s", 0.0, 1, 0.0), (901, "", "s", 0.0, 1, 0.0), (None, items[0], "s", 0.0, 1, 0.0), docs[0], (902, "word " * 200_000, "s", 0.0, 1, 0.0)]
    it = [(i, "t", x, 5) for i, x in enumerate(items)] + [(0, "t", items[0], 5), (50, "t", None, 5), (None, "t", items[0], 5), (51, "t", "", 5), (52, "t", "two words", 5)]
    d, e = spark.createDataFrame(docs, DOC), spark.createDataFrame(it, ITEM)
    got = {(r[0], r[1]) for r in L.leaks(d, e).collect()}
    assert got == want
    assert {(r[0], r[1]) for r in L.leaks(d, e, words_per_block=400).collect()} >= {x for x in want if x[0] % 5 == 0}
    assert L.leaks(d.limit(0), e).count() == 0 and L.leaks(d, e.limit(0)).count() == 0


def test_words_ignore_escapes():
    assert L.words('a\\nb "C_d" &lt;x&gt; \\u0041z') == ["a", "b", "c", "d", "x", "az"]


def naive_repeats(seq, often):
    n, out = len(seq), []
    for i in range(n):
        best = 0
        for k in range(1, i + 2):
            sub = seq[i + 1 - k : i + 1]
            if sum(seq[j : j + k] == sub for j in range(n - k + 1)) >= often:
                best = k
        out.append(best)
    return out


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        seq = [rng.randint(0, 3) for _ in range(rng.randint(1, 40))]
        for often in (2, 3):
            runs = naive_repeats(seq, often)
            assert S.Automaton(seq).repeats(seq, often) == runs
            want = [any(runs[j] >= 2 and j - runs[j] < i <= j for j in range(len(seq))) for i in range(len(seq))]
            assert S.covered(seq, often, 2) == (want if len(seq) >= often else [False] * len(seq))


def test_spam_cases(spark):
    good = "The nightly job has to read the old index before it starts, and then it should write what it found. We keep the log for a week."
    rows = [
        (1, "buy cheap cache tool " * 30), (2, good), (3, "\n".join(f"https://a{i}.example/x" for i in range(20))), (4, good + "\n" + "\n".join(f"- [label {i}](https://x.example/{i})" for i in range(3))),
        (5, "Tags: " + ", ".join(f"red{i} green{i} kit" for i in range(40))), (6, ""), (7, None), (8, "def f(x):\n    return x + 1\n" * 8), (9, "Der Bericht ist noch nicht da, weil niemand in der Gruppe ihn geschrieben hat."),
        (10, "spam words " * 60_000),
        (11, "L'équipe doit relire le fichier avant le départ, car personne ne peut le charger sans elle."), (12, "El equipo debe revisar el informe antes de empezar, porque nadie puede leer el archivo sin la clave."),
    ]
    d = spark.createDataFrame([(a, b, "s", 0.0, 1, 0.0) for a, b in rows + rows[:1]] + [(None, "x y", "s", 0.0, 1, 0.0)], DOC)
    assert {r[0] for r in S.spam(d).collect() if r[0] is not None} == {1, 3, 5, 10}
    assert S.spam(d.limit(0)).count() == 0


def test_stuffed_lines_with_code_marks_are_listed():
    stuffed = "; ".join(f"shard-{a} bridge segment/{b} queue" for a in ("cheap", "tiny", "paged") for b in ("roster", "ledger", "bucket", "depot")) + "; "
    for text in (stuffed, stuffed.replace(";", " ->"), stuffed.replace(";", " ::"), stuffed.replace("; ", ";\n  "), "run(x)\n" + stuffed.replace("; ", ";\n  ")):
        assert S.score(text)[0] > 0.5, text
    for text in ("def f(x):\n    total = x\n    return total\n", "int total = 0;\nfor (int i = 0; i < n; i++) {\n    total += a[i];\n}\n" * 5, "var a=b(1),c={d:e(a),f:g(h)};" * 30):
        assert S.score(text)[0] == 0, text


def test_mix_reaches_targets_and_caps(spark):
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(5, 60), "abc"[min(2, i % 7)], 0.0, 1, 0.0) for i in range(700)] + [(None, "x", "a", 0.0, 1, 0.0), (9001, None, "a", 0.0, 1, 0.0), (9002, "", "b", 0.0, 1, 0.0), (9003, "x", None, 0.0, 1, 0.0), (9004, "y", "zz", 0.0, 1, 0.0)]
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    used, shares = M.mix(spark.createDataFrame(docs, DOC), t)
    s = {r["source"]: r for r in shares.collect()}
    for name, want in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s[name]["share"] - want) < 0.01 and s[name]["most_uses"] <= s[name]["max_repeats"]
    assert s["none"]["tokens_used"] == 0
    assert used.groupBy("doc_id").count().filter("count > 1").count() == 0
    assert any(s[n]["most_uses"] == s[n]["max_repeats"] for n in "abc")
    empty = M.mix(spark.createDataFrame([], DOC), t)
    assert empty[0].count() == 0 and all(r["share"] == 0 for r in empty[1].collect())


def test_mix_reaches_an_entropy(spark):
    docs = [(i, "word " * (5 + i % 50), "aaaaabbc"[i % 8], 0.0, 1, 0.0) for i in range(1600)]
    t = spark.createDataFrame([("a", 0.2, 3), ("b", 0.3, 3), ("c", 0.5, 3)], "source string, target_share double, max_repeats int")
    for want in (0.8, 1.05):
        p = [r["share"] for r in M.mix(spark.createDataFrame(docs, DOC), t, entropy=want)[1].collect()]
        assert abs(-sum(x * math.log(x) for x in p) - want) < 0.01 and abs(sum(p) - 1) < 1e-5


def test_plan_and_temperature():
    tokens = {"a": 1000, "b": 100, "c": 10}
    w, x = M.temperature_weights(tokens, 1.0)
    assert abs(sum(w.values()) - 1) < 1e-9 and 0 < x < 1
    target, caps = {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 4, "c": 8}
    w, budget, x = M.plan(tokens, target, caps)
    assert x == 1.0 and abs(budget - 8 * 10 / 0.5) < 1e-6
    w, budget, x = M.plan(tokens, target, caps, 500)
    assert 0 < x < 1 and all(w[s] * budget <= caps[s] * tokens[s] * 1.000001 for s in tokens)
    assert M.plan({}, target, caps) == ({}, 0.0, 1.0)


def found_share(spark, item, text):
    got = L.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(item))], "item_id long, item_text string"), least_share=0.0).collect()
    return got[0]["share"] if got else 0.0


def test_copies_with_line_prefixes_and_changed_words(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    item, other = [rng.choice(vocab) for _ in range(120)], " ".join(rng.choice(vocab) for _ in range(300))
    texts = {}
    for n in range(3, 11):
        lines = [" ".join(item[i : i + n]) for i in range(0, 120, n)]
        texts[f"numbers {n}"] = other + "\n" + "\n".join(f"{k}: {x}" for k, x in enumerate(lines, 1))
        texts[f"quotes {n}"] = "\n".join(f"> {k:>4} | {x}" for k, x in enumerate(lines, 1))
        texts[f"bare {n}"] = "\n".join(f"{k} {x}" for k, x in enumerate(lines, 1))
        texts[f"words {n}"] = "\n".join(f"[{k}] abc {x}" for k, x in enumerate(lines, 1)) + other
    for n in (4, 5, 6):
        texts[f"every {n}"] = other + " " + " ".join("x" if i % n == n - 1 else w for i, w in enumerate(item))
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item))], "item_id long, item_text string")
    got = {r["doc_id"]: r["share"] for r in L.leaks(docs, items).collect()}
    assert {k: got.get(i, 0) for i, k in enumerate(texts) if got.get(i, 0) < 0.95} == {}
    part = " ".join(item[40:78])
    assert 0.30 <= found_share(spark, item, other + " " + part + " " + other) <= 0.34 and found_share(spark, item, other) == 0
    # Words in another order are no passage, and what is said twice in the document counts once.
    assert found_share(spark, item, " ".join(sorted(item))) < 0.1
    assert found_share(spark, item[:60] + item[:60], " ".join(item[:60])) <= 0.51


def test_passages():
    assert L.passages([(0, 5, 10, 15), (7, 12, 16, 21)]) == [(0, 12, 10, 21)]  # two words left out, one put in
    assert L.passages([(0, 5, 10, 15), (12, 16, 16, 20)]) == [(0, 5, 10, 15), (12, 16, 16, 20)]
    item = np.arange(40)
    assert L.share(item, [(0, 5, 0, 5), (20, 25, 6, 11)]) == 0.0  # short runs that don't follow each other
    assert L.share(item, [(0, 10, 0, 10), (10, 20, 50, 60), (20, 30, 20, 30)]) == 0.5


PROSE = {
    "ru": "Этот сервис читает запись из журнала и отправляет её в очередь. Если очередь полна, он ждёт и пробует ещё раз. Мы проверили это на двух машинах, и всё работало.",
    "zh": "这个服务从日志中读取记录并发送到队列。如果队列已满,它会等待并重试。我们在两台机器上测试过,一切正常。",
    "ja": "このサービスはログからレコードを読み取り、キューに送信します。キューがいっぱいの場合は待機して再試行します。",
    "nl": "Deze dienst leest een record uit het logboek en stuurt het naar de wachtrij. Als de wachtrij vol is, wacht hij en probeert hij het opnieuw.",
    "pl": "Ta usługa czyta rekord z dziennika i wysyła go do kolejki. Jeśli kolejka jest pełna, czeka i próbuje ponownie. Sprawdziliśmy to na dwóch maszynach.",
    "tr": "Bu servis günlükten bir kayıt okur ve kuyruğa gönderir. Kuyruk doluysa bekler ve yeniden dener. Bunu iki makinede denedik ve her şey çalıştı.",
    "fi": "Tämä palvelu lukee tietueen lokista ja lähettää sen jonoon. Jos jono on täynnä, se odottaa ja yrittää uudelleen. Testasimme tämän kahdella koneella.",
    "ko": "이 서비스는 로그에서 레코드를 읽어 큐로 보냅니다. 큐가 가득 차면 기다렸다가 다시 시도합니다. 두 대의 기계에서 시험했습니다.",
    "ar": "تقرأ هذه الخدمة السجل من الملف وترسله إلى الطابور. إذا كان الطابور ممتلئا فإنها تنتظر ثم تحاول مرة أخرى.",
    "it": "Questo servizio legge un record dal registro e lo invia alla coda. Se la coda è piena, aspetta e riprova. Lo abbiamo provato su due macchine.",
    "commits": "Fix login redirect after timeout\nAdd retries to the uploader\nUpdate docs for cache keys\nRemove dead code in parser\nBump version to 2.1\n",
}
LISTS = [
    "запись журнал, очередь сервис, журнал очередь, машина сервис, запись очередь, кэш журнал, сервис кэш, очередь машина",
    "记录、队列、日志、服务、机器、缓存、重试、等待、发送、读取、测试、正常",
    "kuyruk, servis, günlük, kayıt, makine, önbellek, deneme, bekleme, gönderme, okuma, ölçüm, test",
]


def test_prose_of_other_languages_is_no_spam():
    assert {k: S.score(t)[0] for k, t in PROSE.items() if S.score(t)[0] > 0.3} == {}
    assert all(S.score(t)[0] > 0.9 for t in LISTS)


def test_compressed_automaton_gives_the_same():
    rng = random.Random(1)
    for _ in range(300):
        seq = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        want = [False] * len(seq)
        for i, x in enumerate(S.Automaton(seq).repeats(seq, 3)):
            if x >= 2:
                want[i - x + 1 : i + 1] = [True] * x
        assert S.covered(seq, 3, 2) == want
