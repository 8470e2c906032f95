import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.mixing import budgets, earliest_deadline_first, mix, shares_reached
from tallyloom.llm.packing import pack, packing_report, sum_of_squares
from tallyloom.llm.lexicon import CHINESE, JAPANESE, THAI, Lexicon
from tallyloom.llm.sentences import _SOME_WORD, WORDLESS, cheapest_path, sentence_spans, split_sentences
from tallyloom.llm.tokens import sized


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize(
    "sentences",
    [
        ["The crew paid Rs. 4.50 vs. 3 at depot no. 4, i.e. approx. 9 p.m. on 12.03.2025.", "Then it left at 6 p.m.", "According to Dr. J. K. Rao it rained."],
        ["Freight goes through A Pvt. Ltd.", "The Rex Pvt. Ltd. Annexe holds 3 (see fig. 8. for the map)."],
        ["Racks, strips, etc. went first.", "We sold racks, etc.", "Prices rose ... and fell.", "Was it real?!", "eVan crews left!"],
        ['He wrote: "Shutter down. No stock! Call back." and nothing else.', "“Nobody came.”", "(The audit is open; cf. sec. 4.4.)", 'A man asked, "Who pays?"', "Two left."],
        ["Am 4. Tag kamen ca. 9 Kisten, d. h. mehr (vgl. S. 7).", "Der Händler sagte: „Weg. Bis Montag!“ und ging.", "Es fehlen Regale usw.", "Im Lager war Ruhe."],
        ["Quedan aprox. 4 cajas, p. ej. en la pág. 3.", "¿Es real?", "¡Cayó!", "Llegó tarde... pero completo."],
        ["L’écart est-il réel ?", "Il a noté : « Plus rien. Revenez ! » puis il est parti.", "Le stock couvre env. 3 jours, p. ex. au n° 9."],
        ["डॉ. लेन ने रु. 4.50 दिए।", 'उसने कहा, "माल नहीं है। कल आइए।" और गया।', "क्या सही है?"],
        ["كتب المندوب: \"مغلق. لا بضاعة.\" ثم غادر.", "هل الفرق حقيقي؟", "ارتفع السعر إلى ٣٫٥ بعد الأمطار."],
        ["دکاندار نے کہا: \"مال ختم ہے۔ کل آئیں۔\" اور چلا گیا۔", "کیا درست ہے؟"],
        ["สินค้า SKU1 เหลือ 3 ลัง", "พนักงานกลับไป"],
    ],
)
def test_spaced_sentences(sentences):
    assert cut(" ".join(sentences)) == sentences
    assert cut("\n".join(s.replace(" ", "\n", 1) if "SKU1" not in s else s for s in sentences)) == [s.replace(" ", "\n", 1) if "SKU1" not in s else s for s in sentences]


@pytest.mark.parametrize("sentences", [["No.5の倉庫は三日間閉まっていた。", "店主は「品切れです。来てください。」と言った。", "本当？"], ["店主说：“没货了。再来吧！”然后关了门。", "减少了41.0%｡", "雨后。"], ["It left.", "Two came.", "OK!", "A man."]])
def test_sentences_without_blanks_between(sentences):
    assert cut("".join(sentences)) == sentences


def test_blocks_lists_and_blank_texts():
    assert cut("State: X\nPeriod: May 2025\n \nOpen points:\n1. Call 3 shops. Take\na photo.\n2. go\n\nEnd at fig.\n8. Then on") == ["State: X\nPeriod: May 2025", "Open points:", "1. Call 3 shops.", "Take\na photo.", "2. go", "End at fig.\n8.", "Then on"]
    assert cut("x:\n• a\n• b") == ["x:", "• a", "• b"] and cut("") == cut(" \n\t\n ") == cut(None) == []


def test_gaps_of_spaceless_scripts_need_particle_and_opening():
    assert Lexicon(["ました"], ["た"], [], [], []).segment("売れました") == ["売", "れ", "ました"]
    assert JAPANESE.segment("雨が降った") == ["雨", "が", "降", "っ", "た"] and CHINESE.segment("我们走了吗") == ["我们", "走", "了吗"] and THAI.segment("ในเดือนนี้") == ["ใน", "เดือนนี้"]
    assert cut("注文が戻りました\n雨のあと、来た") == ["注文が戻りました", "雨のあと、来た"] and cut("注文が\n戻りました") == ["注文が\n戻りました"]


@pytest.mark.parametrize("gap", [" ", "\n", "\u3000"])
@pytest.mark.parametrize(
    "sentences",
    [["雨が降った", "彼は帰った"], ["他来了", "我走了"], ["誰も来なかった", "しかし荷物は届いた"], ["雪です", "山が白い"], ["店开了吗", "还没有"], ["値段は高いですね", "棚は空だ"], ["大家都吃过了", "后来下雨了"], ["ขอบคุณครับ", "วันนี้ฝนตก"]],
)
def test_sentences_of_spaceless_scripts_without_full_stops(sentences, gap):
    assert cut(gap.join(sentences)) == sentences


@pytest.mark.parametrize("whole", ["東京 大阪", "北京 上海 广州", "彼は\n来た", "私の 本", "他把 书", "来た\nので帰った", "え？と彼は言った。", "走吧！的声音"])
def test_gaps_within_sentences_of_spaceless_scripts(whole):
    assert cut(whole) == [whole]


def test_cheapest_path_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "7", ".", " ", "x", "9"]) for _ in range(14))
        at = sorted(rng.sample(range(1, len(text)), min(6, len(text) - 1)))
        columns = [(a, rng.choice([0.0, 0.5, 1.0, 2.0]), rng.choice([0.0, 0.7, 1.1, 2.5])) for a in at]
        best = None
        for chosen in range(1 << len(columns)):
            ends = [c[0] for i, c in enumerate(columns) if chosen >> i & 1] + [len(text)]
            cost = sum(c[1] if chosen >> i & 1 else c[2] for i, c in enumerate(columns))
            cost += sum(WORDLESS for a, b in zip([0, *ends], ends) if not any(_SOME_WORD.search(text, x, y) for x, y in zip(sorted({a, *[p for p in at if a < p < b]}), sorted({*[p for p in at if a < p < b], b}))))
            best = min(best, (round(cost, 6), ends)) if best else (round(cost, 6), ends)
        got = cheapest_path(columns, text, 0, len(text))
        cost = sum(c[1] if c[0] in got else c[2] for c in columns)
        cost += sum(WORDLESS for a, b in zip([0, *got], got) if not any(_SOME_WORD.search(text, x, y) for x, y in zip(sorted({a, *[p for p in at if a < p < b]}), sorted({*[p for p in at if a < p < b], b}))))
        assert round(cost, 6) == best[0]


def test_readings_depend_on_one_another():
    assert cut("It took 5. Then two left.") == ["It took 5.", "Then two left."] and len(cut("It took 5. 6. Then two left.")) == 2  # "6." alone would be no sentence


def test_every_character_is_in_one_sentence():
    rng = random.Random(1)
    parts = ["The crew left. ", "etc. ", "\n\n", "• x\n", '"', "(", ")", "“", "”", "3.", " ", "สวัสดี ", "。", "。」", "「", "؟", "a.m.", "...", "Ltd. ", "\n", "!", " 1) "]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))
        spans = sentence_spans(t)
        assert all(a < b and t[a:b] == t[a:b].strip() for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())


def test_split_sentences_of_null_repeated_and_very_long_texts(spark):
    long = "The crew left. " * 20_000
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "A b. C d.", 1), (3, "A b. C d.", 2), (4, long, 1), (5, "(" * 5000 + "a. B", 1)], "doc_id long, text string, s int")
    out = [tuple(r) for r in split_sentences(df).collect()]
    assert sorted(r for r in out if r[0] == 3) == [(3, 0, 4), (3, 0, 4), (3, 5, 9), (3, 5, 9)] and sum(r[0] == 4 for r in out) == 20_000 and {r[0] for r in out} == {3, 4, 5}
    assert split_sentences(df.limit(0)).count() == 0


def sum_of_squares_brute(sizes, cap):
    levels, count, out = [], [0] * (cap + 1), []
    for s in sizes:
        best = None
        for h in sorted({0, *(x for x in levels if x + s <= cap)}):
            m = count[:]
            if h:
                m[h] -= 1
            if h + s < cap:
                m[h + s] += 1
            v = sum(x * x for x in m[1:cap])
            best = (v, h) if best is None or v <= best[0] else best
        h = best[1]
        count[h] -= bool(h)
        count[h + s] += h + s < cap
        if h:
            levels.remove(h)
        if h + s < cap:
            levels.append(h + s)
        out.append(h)
    return out


@pytest.mark.parametrize("cap", [1, 2, 5, 10, 17])
def test_sum_of_squares_against_brute_force(cap):
    sizes = np.random.default_rng(cap).integers(1, cap + 1, 300)
    where, fill = sum_of_squares(sizes, cap)
    level, got = {}, []
    for b, s in zip(where, sizes):
        got.append(level.get(b, 0))
        level[b] = level.get(b, 0) + s
    assert got == sum_of_squares_brute(sizes.tolist(), cap) and max(level.values()) <= cap and [level[i] for i in range(len(fill))] == fill.tolist()


@pytest.mark.parametrize("shard", [20_000, 30])
def test_packing_keeps_every_token_once(spark, shard):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, None, 5, 40, 100, 130, 250, 1000])) for i in range(400)] + [(7, 60), (7, 60)]
    items = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 100), (2, 250), (3, None), (4, 0)], "spec_id int, capacity_tokens int")
    out = pack(items, specs, shard).collect()
    for spec, cap in ((1, 100), (2, 250)):
        rows = [r for r in out if r.spec_id == spec]
        held = {}
        for r in rows:
            if r.container_id is None:
                assert r.tok_end == 0
            else:
                held[r.container_id] = held.get(r.container_id, 0) + r.tok_end - r.tok_start
        assert max(held.values()) <= cap and sum(held.values()) == sum(n or 0 for _, n in sizes)
        pieces = {}
        for r in rows:
            pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
        for i, n in sizes:
            if i != 7:
                assert pieces[i] == max(1, -(-(n or 0) // cap))
    assert {r.spec_id for r in out} == {1, 2}
    assert all(r.filled > 0.9 for r in packing_report(pack(items, specs), specs).collect())
    assert pack(items.limit(0), specs).count() == 0 and pack(items, specs.limit(0)).count() == 0


def test_schedule_is_never_a_block_off():
    rng = random.Random(4)
    for _ in range(200):
        blocks = [rng.choice([0, 1, rng.randint(1, 200)]) for _ in range(rng.randint(1, 8))]
        n, at = sum(blocks), [0] * len(blocks)
        out = earliest_deadline_first(blocks)
        assert [t for t, _, _ in out] == list(range(n))
        for t, i, k in out:
            assert k == at[i]
            at[i] += 1
            assert all(abs(a * n - (t + 1) * b) < n for a, b in zip(at, blocks))


@pytest.mark.parametrize("blocks", [[400] + [16] * 40, [3, 1, 777, 20, 20, 0, 500], [1], [6_000] + [4] * 100])
@pytest.mark.parametrize("slots", [1, 50, 333, 10_000])
def test_a_period_repeated_is_the_schedule_of_the_whole_mix(blocks, slots):
    from tallyloom.llm.mixing import periods

    n, each = periods(blocks, slots)
    assert all(n * q >= b and (q > 0) == (b > 0) for q, b in zip(each, blocks)) and sum(each) <= max(slots, 1) + len(blocks)
    one = earliest_deadline_first(each)
    assert [(p * sum(each) + t, i, p * each[i] + k) for p in range(n) for t, i, k in one] == earliest_deadline_first([n * q for q in each])


@pytest.mark.parametrize("n_small, small_docs", [(40, 31), (500, 4), (6, 300)])
def test_a_long_mix_of_many_sources_is_never_a_block_off(spark, monkeypatch, n_small, small_docs):
    from tallyloom.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SLOTS", 100)
    names = [f"s{i}" for i in range(n_small + 1)]
    n_docs = [800] + [small_docs] * n_small
    docs = spark.createDataFrame([(1000 * i + k, names[i]) for i, n in enumerate(n_docs) for k in range(n)], "doc_id long, source string").withColumn("n_tokens", F.lit(1).cast("long"))
    targets = spark.createDataFrame([(s, n / sum(n_docs), 1) for s, n in zip(names, n_docs)], "source string, target_share double, max_repeats int")
    rows = mix(docs, targets, block_tokens=10).collect()
    assert len(rows) == sum(n_docs) == len({r.doc_id for r in rows})
    each = mixing.periods([-(-n // 10) for n in n_docs], 100)
    blocks = {s: each[0] * q for s, q in zip(names, each[1])}
    slots = sum(blocks.values())
    assert all(n / blocks[s] <= 10 for s, n in zip(names, n_docs)) and max(r.slot for r in rows) < slots
    taken = np.zeros((len(names), slots))
    for r in rows:
        taken[int(r.source[1:]), r.slot] += 1
    fluid = np.array(n_docs)[:, None] * np.arange(1, slots + 1)[None, :] / slots
    size = np.array([n / blocks[s] for s, n in zip(names, n_docs)])[:, None]
    assert (np.abs(taken.cumsum(axis=1) - fluid) < size + 1).all()  # less than a block, and the document that its edge cuts


def test_budgets_pass_on_what_a_source_lacks():
    assert budgets({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100, "b": 10, "c": 100}, {"a": 1, "b": 2, "c": 1}, 100) == pytest.approx({"a": 80 * 5 / 7, "b": 20, "c": 80 * 2 / 7})
    assert budgets({"a": 1.0, "b": 0.0}, {"a": 5}, {"a": 2, "b": 9}, 100) == {"a": 10.0, "b": 0.0}


@pytest.mark.parametrize("slots", [50_000, 40])
def test_mix_reaches_shares_and_repeats_in_turn(spark, monkeypatch, slots):
    from tallyloom.llm import mixing

    monkeypatch.setattr(mixing, "MOST_SLOTS", slots)
    rng = random.Random(5)
    docs = [(i, "Big " if i % 3 else "SMALL", rng.randint(1, 30)) for i in range(900)] + [(1000, "tiny", 50), (1001, "other", 500), (1002, None, 500), (1003, "big", 0), (1004, "big", None)]
    targets = [("big", 0.4, 1), ("small", 0.5, 3), ("tiny", 0.08, 2), ("absent", 0.02, 5)]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, source string, n_tokens long, slot int")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed = mix(d, t, block_tokens=100)
    rows = sorted(mixed.collect(), key=lambda r: (r.slot, r.source_start))
    total = sum(n for _, s, n in docs if s and s.strip().lower() in ("big", "small", "tiny") and n)
    drawn = {s: sum(r.n_tokens for r in rows if r.source == s) for s in ("big", "small", "tiny")}
    assert drawn["tiny"] == 100 and abs(drawn["big"] - (total - 100) * 4 / 9) <= 30 and abs(drawn["small"] - (total - 100) * 5 / 9) <= 30
    assert {r.copy_no for r in rows if r.source == "small"} == {1, 2} and {r.copy_no for r in rows if r.source == "big"} == {1}
    assert len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)
    all_tokens, so_far = sum(drawn.values()), dict.fromkeys(drawn, 0)
    for i, r in enumerate(rows):
        so_far[r.source] += r.n_tokens
        done = sum(so_far.values())
        assert all(abs(so_far[s] - done * drawn[s] / all_tokens) < (2 if slots > 100 else 3) * 100 + 30 for s in so_far)
    report = {r.source: r for r in shares_reached(mixed, t).collect()}
    assert report["absent"].n_tokens == 0 and not report["absent"].met and report["tiny"].most_copies == 2 and sum(r.share_reached for r in report.values()) == pytest.approx(1)
    assert mix(d.limit(0), t).count() == 0 and mix(d, t.limit(0)).count() == 0


def test_sizes_of_null_empty_and_long_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Depot 4"), (4, "Depot 4 " * 20_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in sized(df).collect()}
    assert got[1] == got[2] == 0 and 2 <= got[3] <= 6 and got[4] >= 40_000


def test_rows_of_one_doc_id_are_dealt_to_many_shards(spark):
    items = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(50).alias("n_tokens"))
    packed = pack(items, spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int"), shard_items=100)
    rows = packed.collect()
    shards = {r.container_id.split("-")[2] for r in rows if r.container_id.startswith("a-")}
    assert len(rows) == 3000 and len({r.container_id for r in rows}) == 1500 and len(shards) > 20


def test_repeated_and_nameless_items_beyond_the_capacity_keep_containers_of_their_own(spark):
    items = spark.createDataFrame([(7, 250), (7, 250), (None, 230), (None, 230), (None, 100), (8, 40)], "doc_id long, n_tokens long")
    rows = pack(items, spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int")).collect()
    held = {}
    for r in rows:
        held[r.container_id] = held.get(r.container_id, 0) + r.tok_end - r.tok_start
    assert max(held.values()) == 100 and sum(held.values()) == 1100 and sum(v == 100 for v in held.values()) >= 9


def test_packing_and_mixing_faults_see_what_is_wrong(spark):
    from tallyloom.llm.mixing import mixing_faults
    from tallyloom.llm.packing import packing_faults

    items = spark.createDataFrame([(1, 30), (2, 50), (3, 0), (4, 150)], "doc_id long, n_tokens long")
    specs = spark.createDataFrame([(1, 100)], "spec_id int, capacity_tokens int")
    bad = [(1, "a", 1, 0, 0, 30), (1, "a", 2, 0, 0, 20), (1, "b", 2, 1, 20, 50), (1, None, 3, 0, 0, 0), (1, "a", 4, 0, 0, 100)]
    packed = spark.createDataFrame(bad, "spec_id int, container_id string, doc_id long, piece_no int, tok_start long, tok_end long")
    assert tuple(packing_faults(packed, items, specs).first()) == (1, 4, 1, 1, 1)
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 5)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 1, 3), ("b", 3, 1), ("b", 9, 1)], "source string, doc_id long, copy_no int")
    assert {tuple(r) for r in mixing_faults(mixed, docs, targets).collect()} == {("a", 1, 2, 0), ("b", 0, 0, 1)}
