from steploom.llm import answers as A
from steploom.llm import languages as L
from steploom.llm.queries import QUERIES

NONE = L.fit([])


def test_empty_refusal_language():
    for t in (None, "", " \n", "N/A", "{}", "...", "None.", "​", "(empty)", "no answer", '""'):
        assert A.is_empty(t)
    assert not A.is_empty("No caller was found.")
    for t in (
        "i cant answer this one, sorry", "I must decline to propose an edit here.", "My instructions do not permit me to comment on this code.",
        "This request falls outside of what I am permitted to discuss.", "About x.py: I would prefer not to answer.", "No comment.", "We're unable to help with that request.",
        "I'd prefer to leave that one unanswered.", "As a large language model, I can't really offer any advice.", "Giving advice here is against our policies.",
    ):
        assert A.is_refusal(t), t
    for t in (
        "I cannot reproduce the failure with a cold cache.", "The service refused our connection in step 3.", "I would rather stop here than try the same edit.",
        "I could not find any caller.", "We cannot continue the run because the disk is full.", "I am unable to complete this step until the lock is released.",
        "Sorry, the cache cannot be cleared while the server runs.", "The user was told not to edit the file, so read it first.", "I would rather not touch the file.",
        "The rules file does not allow a second entry.", "No comment in the header explains the lock, so read the writer.", "",
    ):
        assert not A.is_refusal(t), t
    for t in (
        "Der Agent hat dieselbe Datei 3 Mal geöffnet.", "Похоже, вызов раньше.", "もう一度実行しました。", "Nada en el registro explica por qué aparecen más entradas.",
        "Agent ponownie otworzył ten sam plik, ale nic nie zmienił.", "Ajan aynı dosyayı tekrar açtı ama hiçbir şeyi değiştirmedi.", "Agenten öppnade samma fil igen utan att ändra något.",
    ):
        assert A.is_other_language(t, NONE), t
    for t in ("Search src/a.py for callers of die_der_das and check them.", "Revert last edit", "rerun selected tests", "`der die das` src/a.py", ""):
        assert not A.is_other_language(t, NONE), t


def test_templates_are_refusals():
    for t in A.REFUSALS:
        assert A.is_refusal(t), t


def test_copies():
    p = A.Prompt(["Step 1\nAction: step_type=run; tool_name=bash; action=pytest tests/a.py::test_x -x\nObservation: 2 failed, 3 passed in 4.5s of the whole suite"])
    assert p.copied("Context: tool_name: bash, action: pytest tests/a.py::test_x -x Observation: 2 failed, 3 passed")
    assert not p.copied("The run shows 2 failed tests, so open tests/a.py and read how test_x builds the cache before any edit.")
    assert not A.Prompt([]).copied("anything at all here") and not p.copied("")
    words = [f"w{i}" for i in range(5000)]
    assert A.Prompt([" ".join(words)]).copied(" ".join(words[100:4000]))


def test_common_length():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    import random

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        assert A.common_length(a, b) == plain(a, b)


R = "prompt_id string, released_prefix_id string, received_at timestamp, evidence_summary string, next_action_description string, why_this_action string"
P = "released_prefix_id string, recent_context_text string, recent_actions_summary string, repeated_pattern_summary string"


def test_truncation_is_learnt_and_edge_rows(spark):
    whole = "Read how the cache is built before any further edit."
    rows = [(f"p{i}", None, None, whole, "Add a log line and rerun the failing case once.", whole) for i in range(6)]
    rows += [
        ("a", "x", None, "Read how the cache is built before any further edit", "Add a log line and rerun the fai", "Add a log line and rerun"),
        ("b", "x", None, whole + " ... <truncated>", "Add a log line (see `", None), (None, "x", None, None, None, None),
        ("c", "x", None, "repeated text from the prompt itself is here", whole, whole), ("c", "x", None, "repeated text from the prompt itself is here", whole, whole),
    ]
    prompts = spark.createDataFrame([("x", "some repeated text from the prompt itself is here", None, None), ("x", None, None, None), (None, "q", None, None)], P)
    got = {tuple(r) for r in A.defects(spark.createDataFrame(rows, R), prompts, NONE).collect()}
    e, n, w = A.FIELDS
    assert got == {("a", n, "truncated"), ("a", w, "truncated"), ("b", e, "truncated"), ("b", n, "truncated"), ("b", w, "empty"), ("c", e, "copied_prompt")}
    assert A.defects(spark.createDataFrame([], R), spark.createDataFrame([], P), NONE).count() == 0


def test_one_defect_per_field(spark, data):
    d = QUERIES["p2_found"](spark, data)
    assert d.count() == d.select("prompt_id", "field_name").distinct().count() > 0
