import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.functions import numbers
from lodestream.functions import text as text_functions
from lodestream.operators import catalog, dispatch, evaluation, metrics, ordering, overlay, packing, validation
from lodestream.operators import settings as settings_of
from lodestream.sources.tables import ContractError, MissingColumns, require_columns


def naive_packs(lengths, capacity, most_items=None):
    bins = []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        fits = [(capacity - sum(lengths[i] for i in b) - lengths[k], j) for j, b in enumerate(bins) if (most_items is None or len(b) < most_items) and sum(lengths[i] for i in b) + lengths[k] <= capacity]
        if fits:
            bins[min(fits)[1]].append(k)
        else:
            bins.append([k])
    bins.sort(key=min)
    return [next(j for j, b in enumerate(bins) if k in b) for k in range(len(lengths))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40), st.none() | st.integers(1, 4))
def test_best_fit_is_the_naive_one(lengths, most):
    assert packing.best_fit(lengths, 20, most) == naive_packs(lengths, 20, most)


def packs_of(spark, lengths, capacity, window=100, **more):
    rows = spark.createDataFrame([(0, k, n) for k, n in enumerate(lengths)], "worker int, id long, length long")
    found = packing.packed(packing.windows(rows, "worker", [F.col("id")], window), "worker", "length", capacity, **more).collect()
    return sorted((r["window"], r["pack"], r["id"]) for r in found)


def test_published_planner_cases(spark):
    found = packs_of(spark, [6, 4, 5], 10, most_items=2)
    assert sorted(i for _, _, i in found) == [0, 1, 2] and found == [(0, 0, 0), (0, 0, 1), (0, 1, 2)]
    with pytest.raises(packing.OversizedExample):
        packs_of(spark, [11], 10, oversized="error")
    assert packs_of(spark, [11, 3], 10) == [(0, 0, 1)]
    assert packs_of(spark, [6, 4], 10, longest=6) == [(0, 0, 0), (0, 0, 1)]
    with pytest.raises(packing.OversizedExample):
        packs_of(spark, [7], 10, longest=6, oversized="error")
    assert packs_of(spark, [2] * 5, 10) == [(0, 0, k) for k in range(5)]
    assert packs_of(spark, [9, 9, 1], 10, window=2) == [(0, 0, 0), (0, 1, 1), (1, 0, 2)]


def test_positions_in_order_and_in_groups(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"g{k % 4}") for k in range(500)], "k long, g string").repartition(7)
    placed = ordering.with_position(rows, [F.desc("k")]).collect()
    assert all(r["position"] == 499 - r["k"] for r in placed) and len(placed) == 500
    found = {}
    for r in ordering.with_group_position(rows, "g", [F.col("k")]).collect():
        found.setdefault(r["g"], []).append((r["k"], r["position"]))
    for each in found.values():
        assert [p for _, p in sorted(each)] == list(range(len(each)))
    assert ordering.with_position(rows.limit(0), [F.col("k")]).count() == 0


def test_running_minimum(spark):
    values = [5, 7, None, 3, 4, 3, 9, 1]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v int").repartition(4)
    found = [r["best"] for r in ordering.running_min(rows, [F.col("k")], "v").orderBy("k").collect()]
    assert found == [5, 5, 5, 3, 3, 3, 3, 1]


def test_running_sum(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([5, 7, None, 3])], "k long, v long").repartition(3)
    assert [r["total"] for r in ordering.running_sum(rows, [F.col("k")], "v").orderBy("k").collect()] == [5, 12, 12, 15]


def test_quantiles_of_a_hot_value(spark):
    rows = spark.createDataFrame([(7,)] * 90 + [(k,) for k in range(10)] + [(None,)], "v int").repartition(5)
    want = sorted([7] * 90 + list(range(10)))
    found = {r["share"]: r["v"] for r in metrics.exact_quantiles(rows, "v", [0.0, 0.05, 0.5, 0.99, 1.0]).collect()}
    assert found == {q: want[round(99 * q)] for q in (0.0, 0.05, 0.5, 0.99, 1.0)}


def test_orders_keep_each_row_once(spark):
    rows = spark.createDataFrame([(k, f"s{k % 3 if k % 2 else 0}") for k in range(200)], "k long, s string")
    a, b = ordering.shuffled(rows, 1, 0, "k").collect(), ordering.shuffled(rows.repartition(5), 1, 0, "k").collect()
    assert sorted((r["k"], r["position"]) for r in a) == sorted((r["k"], r["position"]) for r in b)
    assert sorted((r["k"], r["position"]) for r in ordering.shuffled(rows, 1, 1, "k").collect()) != sorted((r["k"], r["position"]) for r in a)
    blocks = ordering.block_shuffled(rows, 1, 0, [F.col("k")], 20, "k").collect()
    assert all(r["k"] // 20 == r["position"] // 20 for r in blocks)
    mixed = sorted(ordering.interleaved(rows, "s", [F.col("k")], 1).collect(), key=lambda r: r["position"])
    for s in ("s0", "s1", "s2"):
        own = [r["k"] for r in mixed if r["s"] == s]
        assert own == sorted(own) and len({len(own) // 4 - sum(r["s"] == s for r in mixed[:50]) for _ in (0,)} - {-2, -1, 0, 1, 2}) == 0
    stripes = ordering.stripes(rows, 1, 0, "s", 2, 2).collect()
    assert len(stripes) == 3 and {r["rank"] for r in stripes} == {0, 1}
    even = ordering.synchronised(rows, "s", [F.col("k")]).groupBy("s").count().collect()
    assert len({r["count"] for r in even}) == 1


def test_streams_are_cut_in_order(spark):
    rows = spark.createDataFrame([(s, k, w) for s in (1, 2) for k, w in enumerate([3, 3, 5, 9, 1, 1, 1, 1])], "s int, k long, w long").repartition(4)
    found = packing.request_chunks(rows, "s", ["k"], "w", 3, 8).collect()
    assert [r["chunk"] for r in sorted(found, key=lambda r: (r["s"], r["k"]))] == [0, 0, 1, 2, 3, 3, 3, 4] * 2
    found = packing.accumulation_groups(rows, "s", ["k"], "w", 8, 3).collect()
    assert [r["group"] for r in sorted(found, key=lambda r: (r["s"], r["k"]))] == [0, 0, 0, 1, 2, 2, 2, 3] * 2


def test_layout(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2], [3], [4, 5], 2), (0, 1, [], None, [6], 0)], "pack int, k int, before array<int>, after array<int>, target array<int>, audio int")
    tokens = packing.layout(rows, ["pack"], [F.col("k")]).orderBy("place").collect()
    assert [r["id"] for r in tokens] == [1, 2, 0, 0, 0, 0, 3, 4, 5, 0, 0, 6]
    assert [r["pos"] for r in tokens] == [*range(9), 0, 1, 2] and [r["seq"] for r in tokens] == [0] * 9 + [1] * 3
    assert [r["label"] for r in tokens] == [-100] * 7 + [4, 5, -100, -100, 6]
    assert [r["supervised"] for r in tokens] == [False] * 6 + [True, True, False, False, True, False]
    assert [r["audio_slot"] for r in tokens] == [False] * 2 + [True] * 4 + [False] * 3 + [True, True, False]
    assert sum(r["audio_frame"] for r in tokens) == 2
    made = packing.layout(rows, ["pack"], [F.col("k")])
    assert packing.layout_faults(made, ["pack"], 12, 100).count() == 0
    assert packing.layout_faults(made, ["pack"], 11, 100).first()["rule"] == "too_long"
    assert packing.layout_faults(made, ["pack"], 12, 6).first()["rule"] == "vocabulary"


def test_committed_packs(spark):
    packs = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "pack int, id string")
    done = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert [r["id"] for r in packing.uncommitted(packs, ["pack"], "id", done).collect()] == ["c"]
    with pytest.raises(ContractError, match="in part"):
        packing.uncommitted(packs, ["pack"], "id", done.filter("id = 'a'"))
    with pytest.raises(ContractError, match="several"):
        packing.uncommitted(packs.union(spark.createDataFrame([(2, "c")], packs.schema)), ["pack"], "id", done)


def test_catalog(spark):
    audio = spark.createDataFrame([(f"train-{k}", "d", "0" * 64, 9, "s", ["train_base"] if k else None, 1, "k", "x.tar") for k in range(2)] + [("dev-0", "d", "0" * 64, 9, "s", ["dev", "test"], 1, "k", "x.tar")], "audio_id string, dataset string, flac_sha256 string, flac_size int, source_id string, splits array<string>, target_count int, wds_key string, wds_shard string")
    rows = catalog.audio_rows(audio)
    assert [r["splits"] for r in rows.orderBy("audio_id").collect()] == [["dev", "test"], [], ["train_base"]]
    assert rows.filter(catalog.in_splits("splits", ["dev", "train_base"])).count() == 2
    targets = spark.createDataFrame([("train-0", "t2", "style_caption", "b"), ("train-0", "t1", "style_caption", "a"), ("train-0", "t3", "transcription", "c"), ("dev-0", "t4", "style_caption", "d")], "audio_id string, target_id string, target_type string, text string")
    nested = catalog.nested_index(rows, targets, "audio_id", "target_id", F.col("target_type"), "style_caption", "transcription", "text").orderBy("audio_id").collect()
    assert [[c["text"] for c in r["captions"]] for r in nested] == [["d"], ["a", "b"], []] and [r["n_transcripts"] for r in nested] == [0, 1, 0]
    with pytest.raises(validation.MissingRows, match="no transcription"):
        catalog.paired_sources(targets, "audio_id", "target_type", "style_caption", "transcription")
    assert catalog.paired_sources(targets.filter("audio_id = 'train-0'"), "audio_id", "target_type", "style_caption", "transcription").count() == 2
    with pytest.raises(validation.LeakageError):
        validation.require_apart(rows, "splits", [("dev", "test")])
    validation.require_apart(rows, "splits", [("dev", "train_base")])
    with pytest.raises(MissingColumns, match="nope"):
        require_columns(rows, ["audio_id", "nope"])
    raw = spark.createDataFrame([("a", "t", "k", "x", "s", "o", "", None, "", None)], "audio_id string, target_id string, target_type string, text string, split string, source string, generator_model string, generator_revision string, prompt_sha256 string, review_status string")
    assert catalog.target_rows(raw).first()[6:] == (None, None, None, "")


def test_contracts_fire(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (2, "b")], "k int, s string")
    with pytest.raises(validation.DuplicateKey):
        validation.require_unique(rows, "k")
    found = {r["rule"]: r["n_rows"] for r in validation.faults(rows, {"small": F.col("k") < 2, "named": F.col("s") != "b"}).collect()}
    assert found == {"small": 1, "named": 2}
    with pytest.raises(ContractError, match="named"):
        validation.require_none(validation.faults(rows, {"named": F.col("s") != "b"}))
    with pytest.raises(validation.LimitExceeded):
        validation.require_at_most(rows, F.col("k") == 1, 1)
    validation.require_at_most(rows, F.col("k") == 1, 2)
    with pytest.raises(validation.MissingRows):
        validation.require_covered(rows, rows.filter("k = 1"), "k")


LOG = "line long, row_index long, id string, text string, failed boolean"


def test_last_prediction_wins(spark):
    rows = spark.createDataFrame([(0, 1, "x", "old", False), (1, 1, "x", "new", False), (2, None, "1", "other", False)], LOG)
    key = evaluation.prediction_key(F.col("row_index"), F.col("id"))
    found = evaluation.last_wins(rows, key, "line", ["text"]).orderBy("first_line").collect()
    assert [r["text"] for r in found] == ["new", "other"]
    by_id = evaluation.prediction_key(F.col("row_index"), F.lit("same"), by_id=True)
    assert [r["text"] for r in evaluation.last_wins(rows, by_id, "line", ["text"]).collect()] == ["other"]


def test_resuming(spark):
    rows = spark.createDataFrame([(0, None, "a", "", False), (1, 1, "b", "", True), (2, 2, "c", "", False)], LOG)
    assert sorted(r[0] for r in evaluation.completed_rows(rows, 3).collect()) == [0, 2]
    with pytest.raises(ContractError, match="outside"):
        evaluation.completed_rows(rows, 2)
    with pytest.raises(ContractError, match="placed"):
        evaluation.completed_rows(rows.withColumn("row_index", F.lit(None).cast("long")), 3)
    with pytest.raises(ContractError, match="not in the source"):
        evaluation.pending(rows.limit(1), rows, "line")


def test_error_keys_count_even_with_null(spark):
    rows = spark.createDataFrame([('{"error": null}',), ('{"prediction": "x"}',), ("[]",)], "l string")
    assert [r[0] for r in rows.select(evaluation.has_error(F.col("l"))).collect()] == [True, False, False]


def test_benchmark_rows_of_any_shape(spark):
    odd = spark.createDataFrame([(None, " 7 ", "q", {"a": "x", "b": " "}, "clip.txt", None)], "id string, key string, prompt string, options map<string,string>, audio_id string, context array<string>")
    row = evaluation.normalised(odd).first()
    assert (row["sample_id"], row["question"], row["choices"], row["audio"]) == ("7", "q", ["x"], None)
    letters = spark.createDataFrame([("q1", "b", None, " ", ["1.wav", "2.wav"], b"x")], "question_id string, choice_b string, choice_a string, choice_c string, audio_path array<string>, raw binary")
    row = evaluation.normalised(letters).first()
    assert row["choices"] == ["b"] and row["audio"] == ["1.wav", "2.wav"] and "raw" not in row["source_record"]
    empty = spark.createDataFrame([([], "b")], "choices array<string>, choice_a string")
    assert evaluation.normalised(empty).first()["choices"] == []


def test_scorer_records(spark):
    rows = spark.createDataFrame([('{"a": "1", "other": "{\\"b\\": 2, \\"a\\": 3}", "model_output": "old"}', "new")], "r string, p string")
    made = evaluation.flattened(evaluation.merged_record(F.col("r"), model_output=F.col("p")), "other")
    assert rows.select(made.alias("m")).first()["m"] == {"a": "3", "b": "2", "model_output": "new"}
    record = '{"reference": "r", "text": "t", "eval_aspect": "e", "answer_choice": "B", "category": "c", "constraints": [1]}'
    found = {s: evaluation.benchmark_record(F.lit(s), F.lit("p"), F.lit(record)) for s in ("elyza", "m-ifeval", "jamc-qa")}
    made = {s: spark.range(1).select(c.alias("x")).first()["x"] for s, c in found.items()}
    assert made["elyza"]["references"] == ["r"] and '"role":"user","content":"t"' in made["elyza"]["task_inputs"]
    assert made["m-ifeval"]["task_inputs"] == '{"constraints":[1]}' and made["jamc-qa"]["references"] == ["B"]
    with pytest.raises(Exception, match="unknown subset"):
        spark.range(1).select(evaluation.benchmark_record(F.lit("x"), F.lit("p"), F.lit(record))).collect()


def test_majority_vote_over_deduplicated_judges(spark):
    rows = spark.createDataFrame([(0, "a", None, "p", "r", ["Yes", "yes", "No"]), (1, "", "b", "p", "r", ["No", "No", "Yes"]), (2, None, "b", "p", "r", ["No", "No", "Yes"])], "line int, id string, key string, prompt string, reference string, score array<string>")
    from lodestream.functions.text import yes_wins

    kept = evaluation.last_wins(rows, evaluation.judge_key(rows), "line", ["score"])
    assert tuple(kept.agg(F.avg(yes_wins(F.col("score")).cast("int") * 100), F.count("*")).first()) == (50.0, 2)


def test_judgements_are_used_whole_or_not_at_all(spark):
    wanted = spark.createDataFrame([(0,), (1,)], "i int")
    whole = spark.createDataFrame([(0, "a"), (1, "b")], "i int, s string")
    assert evaluation.aligned_judgements(whole, wanted, "i").count() == 2
    assert evaluation.aligned_judgements(whole.limit(1), wanted, "i") is None
    assert evaluation.aligned_judgements(whole.union(whole.limit(1)), wanted, "i") is None


def test_metrics(spark):
    rows = spark.createDataFrame([("a", 2.0, 1), ("a", 2.0, 4), ("b", 3.0, 1)], "k string, loss double, tokens int")
    found = metrics.token_nll(rows, "k", "loss", "tokens").first()
    assert (found["token_nll"], found["target_nll"], found["key_nll"]) == pytest.approx((7 / 6, 5.5 / 3, (1.25 + 3) / 2))
    scores = spark.createDataFrame([("open", 0.739872), ("if", 0.206897)], "c string, v double")
    assert metrics.macro_mean(scores, "c", F.col("v")).first()["score"] == pytest.approx(0.473384, abs=1e-6)
    nulls = spark.createDataFrame([("x", 1.0), ("x", None)], "c string, v double")
    from lodestream.functions.numbers import full_mean

    assert tuple(nulls.agg(full_mean(F.col("v")), F.count("*")).first()) == (0.5, 2)
    labels = {r["label"]: (r["n_rows"], r["share"], r["score"]) for r in metrics.label_distribution(spark.createDataFrame([("a",), (None,), ("z",), ("a",)], "l string"), "l", {"a": 1.0, "b": 0.5}).collect()}
    assert labels == {"a": (2, 0.5, 0.5), "b": (0, 0.0, 0.0)}
    ten = spark.createDataFrame([(k,) for k in range(10)], "v int")
    assert {r["share"]: r["v"] for r in metrics.exact_quantiles(ten, "v", [0.5, 1.0]).collect()} == {0.5: 4, 1.0: 9}
    assert metrics.exact_quantiles(ten.limit(0), "v", [0.5]).count() == 0
    made = metrics.throughput(spark.createDataFrame([(50, 5, 10.0, 2.0, 1.0), (50, 5, 10.0, 2.0, 0.0)], "tokens int, supervised int, loss double, elapsed double, waited double"), 100).first()
    assert tuple(made) == (2.0, 0.5, 25.0, 20.0)


def make(texts):
    return [(f" {t.upper()} ", "length" if "2" in t else "stop", len(t)) for t in texts]


def test_an_overlay_is_taken_up_where_it_stopped(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"t{k}", "style_caption", f"text {k}", "train") for k in range(5)] + [("a", "x", "other", "", "train")], "audio_id string, target_id string, target_type string, text string, split string")
    targets, path = overlay.source_targets(rows, ["style_caption"]), str(tmp_path / "parts")
    first = overlay.expand(targets, make, path, overlay.recipe_hash(model="m"), limit=2)
    assert first.count() == 2
    whole = overlay.expand(targets, make, path, overlay.recipe_hash(model="m"))
    assert {r["official_target_id"]: (r["text"], r["truncated"]) for r in whole.collect()} == {f"t{k}": (f"TEXT {k}", k == 2) for k in range(5)}
    assert overlay.expand(targets, make, path, overlay.recipe_hash(model="m")).count() == 5
    with pytest.raises(ContractError, match="another recipe"):
        overlay.expand(targets, make, path, overlay.recipe_hash(model="n"))
    with pytest.raises(ContractError, match="not in the source"):
        overlay.expand(targets.filter("target_id < 't3'"), make, path, overlay.recipe_hash(model="m"))
    with pytest.raises(ContractError, match="no text"):
        overlay.source_targets(rows, ["other"])
    with pytest.raises(ContractError, match="no targets"):
        overlay.source_targets(rows, ["gone"])
    assert overlay.source_targets(rows.filter("text <> ''"), ["style_caption"]).count() == 5


@pytest.mark.parametrize("block", [16, 40])
def test_blocks_number_chunks_as_one_stream_does(spark, monkeypatch, block):
    rng = random.Random(block)
    rows = [(s, k, rng.choice([0, 1, 2, 5, 9, None])) for s, n in (("a", 211), ("b", 1), (None, 64), ("c", 32)) for k in range(n)]
    df = spark.createDataFrame(rows, "stream string, k long, w long")

    def found():
        out = [packing.request_chunks(df, "stream", ["k"], "w", 4, 10), packing.accumulation_groups(df, "stream", ["k"], "w", 12, 4, "chunk")]
        return [sorted(((r["stream"], r["k"], r["w"], r["chunk"]) for r in x.collect()), key=str) for x in out]

    plain = found()
    monkeypatch.setattr(packing, "BLOCKS_FROM", 0)
    monkeypatch.setattr(packing, "BLOCK_ROWS", block)
    assert found() == plain


def test_requests_in_flight(spark):
    rows = spark.createDataFrame([(0, 0, 4.0), (0, 1, 5.0), (0, 2, None), (0, 3, 10.0), (0, 4, 0.0)], "worker int, k long, seconds double")
    found = {r["k"]: r["wave"] for r in packing.in_flight(rows, "worker", ["k"], "seconds", 10.0, 100).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 1, 4: 2}
    with pytest.raises(ContractError, match="exceeds"):
        packing.in_flight(rows, "worker", ["k"], "seconds", 9.0, 100)
    with pytest.raises(ContractError, match="positive"):
        packing.in_flight(rows, "worker", ["k"], "seconds", 0, 100)


def test_a_grid_packs_each_pair_as_alone(spark):
    rng = random.Random(1)
    lengths = [rng.randint(1, 30) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(lengths)), "k long, length long")
    found = {(r["capacity"], r["size"]): r for r in packing.grid(df, [F.col("k")], "length", [20, 25], [8, 50]).collect()}
    for capacity in (20, 25):
        fitting = [n for n in lengths if n <= capacity]
        for size in (8, 50):
            n = sum(max(naive_packs(fitting[x : x + size], capacity), default=-1) + 1 for x in range(0, len(fitting), size))
            r = found[capacity, size]
            assert (r["n_packs"], r["n_items"], r["tokens"], r["lower_bound"]) == (n, len(fitting), sum(fitting), -(-sum(fitting) // capacity))


def test_merged_statistics_of_workers_with_nothing_that_fits(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("a", 1, 50), ("b", 0, 60)], "worker string, k long, length long")
    placed = packing.windows(rows, "worker", [F.col("k")], 4)
    each = packing.pack_stats(packing.packed(placed, "worker", "length", 10), ["worker"], "worker", "length", 10, placed)
    assert {r["worker"]: (r["n_packs"], r["n_oversized"], r["utilisation"]) for r in each.collect()} == {"a": (1, 1, 0.5), "b": (0, 1, None)}
    total = packing.merge_stats(each, [], F.lit(10)).first()
    assert (total["n_packs"], total["n_items"], total["n_oversized"], total["lower_bound"], total["utilisation"]) == (1, 1, 2, 1, 0.5)


def test_names_that_nothing_has_are_refused(spark):
    rows = spark.createDataFrame([(1, "x", "t")], "id long, dataset string, text string")
    with pytest.raises(ContractError, match="no backend"):
        dispatch.by_backend(rows, "dataset", {"y": lambda df: df})
    with pytest.raises(ContractError, match="unknown tokenizer"):
        dispatch.packable(rows, "id", {"before": F.col("text")}, F.lit(0), "none", "whisper")
    with pytest.raises(ContractError, match="unexpected weight"):
        settings_of.mapped_names(rows, "dataset", "w.", "v.")
    with pytest.raises(ContractError, match="break the rule audio_limit"):
        settings_of.require_settings({"client": {"max_model_len": 1}, "server": {"max_model_len": 1}}, settings_of.RUNTIME)


def test_white_space_of_every_kind_is_stripped(spark):
    text = "".join(text_functions.WHITE_SPACE)
    assert text.strip() == "" and not any(chr(k).isspace() and chr(k) not in text for k in range(0x3001))
    df = spark.createDataFrame([(f"{text}a{text}b{text}",), (text,)], "t string")
    assert [r[0] for r in df.select(text_functions.stripped(F.col("t"))).collect()] == [f"a{text}b", ""]
    with pytest.raises(Exception, match="blank"):
        df.select(text_functions.messages(("user", F.col("t")))).collect()

# Published counts and accuracies of nine subsets, and their mean weighted by counts.
PUBLISHED = [
    (276, 0.322463768115942),
    (98, 0.25510204081632654),
    (270, 0.825925925925926),
    (41, 0.04878048780487805),
    (100, 0.27),
    (100, 0.32),
    (100, 0.38),
    (180, 0.35555555555555557),
    (1039, 0.3503368623676612),
]
PUBLISHED_MEAN = 0.39201451905626133


def test_published_weighted_accuracy(spark):
    rows = spark.createDataFrame(PUBLISHED, "n long, value double")
    found = rows.agg(numbers.weighted_mean(F.col("value"), F.col("n")).alias("mean"), F.sum("n").alias("n")).first()
    assert found["n"] == 2204 and found["mean"] == pytest.approx(PUBLISHED_MEAN, abs=1e-12)
