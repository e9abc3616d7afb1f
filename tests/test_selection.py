import random

import pytest

from testlattice.operators import selection as sel

P = "org.example."
MAP = {
    "OwnerControllerTests#testShowOwner": ([P + "controller.OwnerController", P + "model.Owner"], [P + "controller.OwnerController#showOwner", P + "model.Owner#getName"]),
    "PetControllerTests#testCreatePet": ([P + "controller.PetController", P + "model.Pet"], [P + "controller.PetController#createPet", P + "model.Pet#setName"]),
    "VetControllerTests#testShowVets": ([P + "controller.VetController", P + "model.Vet"], [P + "controller.VetController#showVetList", P + "model.Vet#getSpecialties"]),
}
OWNER, PET = P + "controller.OwnerController", P + "controller.PetController"


def run(spark, mapping, classes, methods):
    cov_class = spark.createDataFrame([(t, i, c) for t, (cs, _) in mapping.items() for i, c in enumerate(cs)], "test_name string, pos int, class_fqn string")
    cov_method = spark.createDataFrame([(t, i, m) for t, (_, ms) in mapping.items() for i, m in enumerate(ms)], "test_name string, pos int, method_fqn string")
    changed_class, changed_method = spark.createDataFrame([(c,) for c in classes], "class_fqn string"), spark.createDataFrame([(m,) for m in methods], "method_fqn string")
    return {r["test_name"]: r["matched_by"] for r in sel.select_tests(cov_method, cov_class, changed_method, changed_class).collect()}


@pytest.mark.parametrize(
    "classes, methods, want",
    [
        ([OWNER], [], {"Owner": "CLASS"}),
        ([P + "model.Owner", P + "model.Pet"], [], {"Owner": "CLASS", "Pet": "CLASS"}),
        ([], [], {}),
        ([P + "util.SomeUtility"], [], {}),
        ([], [OWNER + "#showOwner"], {"Owner": "METHOD"}),
        ([P + "model.Owner"], [PET + "#createPet"], {"Owner": "CLASS", "Pet": "METHOD"}),
        ([OWNER], [OWNER + "#showOwner"], {"Owner": "METHOD"}),
        ([OWNER], [OWNER + "#toString"], {"Owner": "ESCALATED"}),
        ([P + "util.SomeUtility"], [P + "util.SomeUtility#doSomething"], {}),
    ],
)
def test_three_test_map(spark, classes, methods, want):
    got = run(spark, MAP, classes, methods)
    assert {t.split("Controller")[0]: k for t, k in got.items()} == want


def test_first_hit_decides_the_credit(spark):
    mapping = {"T1#a": (["A", "B"], ["A#a", "B#b"]), "T2#a": (["B"], ["B#x"])}
    assert run(spark, mapping, [], ["A#a", "B#b"]) == {"T1#a": "METHOD", "T2#a": "ESCALATED"}


def model(mapping, classes, methods):
    """A plain reading of the rules."""
    info = {m.split("#")[0] for m in methods}
    only, out, credited = set(classes) - info, {}, set()
    for t, (cs, ms) in mapping.items():
        hit = next((m for m in ms if m in methods), None)
        if hit:
            out[t] = "METHOD"
            credited.add(hit.split("#")[0])
        elif only & set(cs):
            out[t] = "CLASS"
    for t, (cs, _) in mapping.items():
        if t not in out and (info - credited) & set(cs):
            out[t] = "ESCALATED"
    return out


def test_random_maps_against_the_model(spark):
    rng = random.Random(5)
    names = [f"p.C{i}" for i in range(6)]
    mapping, classes, methods = {}, set(), set()
    for world in range(40):  # worlds share one job but no class
        own = [f"{n}w{world}" for n in names]
        for t in range(5):
            ms = [f"{rng.choice(own)}#m{rng.randrange(3)}" for _ in range(rng.randrange(5))]
            mapping[f"W{world}T{t}#x"] = (rng.sample(own, rng.randrange(4)), list(dict.fromkeys(ms)))
        classes |= set(rng.sample(own, rng.randrange(3)))
        methods |= {f"{rng.choice(own)}#m{rng.randrange(4)}" for _ in range(rng.randrange(4))}
    assert run(spark, mapping, classes, methods) == model(mapping, classes, methods)


def test_statuses(spark):
    good = {"commit_id": "abcdefg"}
    assert sel.status_of(None, True, 0, None, True)[0] == "FULL_SUITE"
    assert sel.status_of({"commit_id": ""}, True, 0, None, True)[0] == "FULL_SUITE"
    assert sel.status_of(good, False, 0, None, True)[0] == "FULL_SUITE"
    assert sel.status_of(good, True, 501, None, True) == ("FULL_SUITE", "Commit distance 501 exceeds max 500 — mapping is too stale")
    assert sel.status_of(good, True, 1, "pom.xml (pattern: *.xml)", True)[0] == "FULL_SUITE"
    assert sel.status_of(good, True, 1, None, False)[0] == "NONE"
    assert sel.status_of(good, True, 1, None, True)[0] == "SELECTED"
    assert [sel.prefer_mode(x) for x in (None, "", "remote", " Local ", "other")] == ["NEAREST", "NEAREST", "REMOTE", "LOCAL", "NEAREST"]


def test_triggers_filters_and_nearest(spark):
    files = spark.createDataFrame([("b/build.gradle",), ("a/pom.xml",), ("z.txt",), (None,)], "path string")
    assert [tuple(r) for r in sel.trigger_match(files, ["nothing", "**/pom.xml", "**/*.gradle"]).collect()] == [("a/pom.xml", "**/pom.xml")]
    assert sel.trigger_match(files, ["nothing"]).isEmpty() and sel.trigger_match(files, []).isEmpty()
    tests = spark.createDataFrame([("FooTest#testA",), ("FooTest#testB",), ("BarTest#testC",)], "test_name string")
    none, some = spark.createDataFrame([], "class_fqn string"), spark.createDataFrame([("a.NewTest",)], "class_fqn string")
    lines = lambda *a, **k: sorted(r["line"] for r in sel.filter_lines(*a, **k).collect())
    assert lines("SELECTED", tests, none) == ["BarTest", "FooTest"]
    assert lines("NONE", tests, none) == [sel.SENTINEL] and lines("NONE", tests, some) == ["a/NewTest.java"]
    assert lines("FULL_SUITE", tests, some) == lines(None, tests, none) == sorted(sel.DEFAULT_PATTERNS)
    assert lines("SELECTED", tests, some, patterns=True) == ["BarTest.testC", "FooTest.testA", "FooTest.testB", "a.NewTest.*"]
    slots = spark.createDataFrame([("p", "remote", 3), ("p", "local", 3), ("q", "remote", 4), ("q", "local", 2), ("r", "remote", None)], "project string, slot string, distance int")
    assert sorted(tuple(r) for r in sel.nearest_map(slots).collect()) == [("p", "remote", 3), ("q", "local", 2), ("r", "remote", 2147483647)]
