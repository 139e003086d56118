import random

from lotline.llm import chat as H


def brute(rows):
    conv = {}
    for c, turn, role, text in {(c, t, r or "", x or "") for c, t, r, x in rows if c is not None}:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role, text))
    seqs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    out = []
    for c, s in seqs.items():
        equal = [d for d, o in seqs.items() if o == s]
        if c == min(equal) and not any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            out.append((c, len(s), len(equal), "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in s)))
    return sorted(out)


def ours(spark, rows):
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, block string")
    return sorted((r.conv_id, r.n_turns, r.copies, r.text) for r in H.collapse(df).collect())


def test_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 3)
    rnd = random.Random(6)
    rows = []
    for c in range(80):
        for t in range(rnd.randrange(1, 12)):
            rows.append((c, t, ["user", "assistant"][t % 2], rnd.choice("ab") if t < 3 else f"{c % 4}{t}"))
    rows += [(100, 0, None, None), (101, 0, "", ""), (102, None, "user", "x"), (102, 1, "user", "y"), (None, 0, "user", "z"),
             (103, 0, "user", "x"), (103, 0, "user", "x"), (104, 5, "user", "x" * 100000), (105, 0, "a", "bc"), (106, 0, "ab", "c")]
    rnd.shuffle(rows)
    assert ours(spark, rows) == brute(rows)


def test_one_long_conversation_and_none(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)
    rows = [(1, t, "user", f"t{t}") for t in range(200)] + [(2, t, "user", f"t{t}") for t in range(150)] + [(3, 0, "user", "t0")]
    assert ours(spark, rows) == brute(rows)
    assert ours(spark, []) == []
