import hashlib

import numpy as np
import pytest

from basketlens.llm.chat import digest, escape, format_windows, pack, parse, unescape

CONTROL = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<|b", "<", "|", "%0A", "\n", "ends <"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "conv_id long, turn long, role string, text string, span int, no string, kind int")


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rng = np.random.default_rng(9)
    rows = []
    for conv in range(12):
        n = 700 if conv == 5 else int(rng.integers(1, 12))
        for turn in range(n):
            role = "system" if turn == 0 and conv % 2 else ["user", "assistant"][turn % 2]
            text = " ".join(["wörd", CONTROL[int(rng.integers(0, len(CONTROL)))], "x,y"][int(k)] for k in rng.integers(0, 3, int(rng.integers(0, 40))))
            rows.append((conv, turn, role, text))
    rows += [(20, 0, "user", None), (20, 1, "assistant", None), (20, None, "assistant", "first"), (21, 0, None, "x"), (21, 0, "assistant", "same"), (21, 0, "assistant", "same"),
             (22, 3, "a\nb%0A", "odd role"), (23, 0, "user", "q " * 5000), (23, 1, "assistant", "a " * 5000), (None, 1, "assistant", "no id"), (-7, -300, "user", "negative"), (-7, 300, "assistant", "turns")]
    return rows


@pytest.mark.parametrize("budget,history,history_budget", [(128, 3, 40), (2048, 4, 512), (128, 0, 0)])
def test_reading_back_gives_every_turn_and_target_once(spark, budget, history, history_budget):
    rows = conversations()
    windows = format_windows(frame(spark, rows), budget, history, history_budget)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest(windows).collect()}
    assert got == brute(rows)


def test_budget_history_and_masks(spark):
    rows = conversations()
    for w in format_windows(frame(spark, rows), 128, 3, 40).collect():
        turns = parse(w.text)
        assert len(turns) == w.n_repeated + w.n_new and w.n_new >= 1
        assert w.n_tokens <= 128 or w.n_new == 1
        targets = [t for r, t in turns[w.n_repeated:] if r == "assistant"]
        assert [unescape(w.text[s["start"]:s["end"]]) for s in w.loss] == targets
        if w.conv_id == 5 and w.first_turn > 0:
            assert turns[0][0] == "system" and 1 <= w.n_repeated <= 4
        text = w.text.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert "<|" not in text


def test_escape_is_reversible_and_pack_is_greedy():
    rng = np.random.default_rng(10)
    for _ in range(2000):
        text = "".join(np.array(["<", "\\", "|", "a"])[rng.integers(0, 4, 12)])
        assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert pack([5, 5, 5, 30, 5, 5], 0, 12) == [(0, 2), (2, 3), (3, 4), (4, 6)]


def plain_windows(turns, budget, history, history_budget):
    """[(first shown, first new, end)] of one conversation's (role, tokens), by stepping turn by turn."""
    lead = turns[0][1] if turns and turns[0][0] == "system" else None
    fixed = lead or 0
    out, a = [], 0
    while a < len(turns):
        floor = 0 if lead is None else 1
        head = 0 if lead is not None and a == 0 else fixed
        room = min(history_budget - max(0, fixed - budget // 2), budget - fixed - turns[a][1])
        first, size = a, head
        for j in range(a - 1, max(floor, a - history) - 1, -1):
            if size - head + turns[j][1] > room:
                break
            first, size = j, size + turns[j][1]
        b = a
        while b < len(turns) and (b == a or size + turns[b][1] <= budget):
            size += turns[b][1]
            b += 1
        out.append((first, a, b, size))
        a = b
    return out


def test_windows_by_stepping(spark):
    rng = np.random.default_rng(19)
    rows, want = [], {}
    for conv in range(30):
        turns = [("system" if k == 0 and conv % 3 == 0 else ["user", "assistant"][k % 2], int(rng.integers(0, [30, 300][conv % 2]))) for k in range(int(rng.integers(1, 40)))]
        rows += [(conv, k, role, "w " * n) for k, (role, n) in enumerate(turns)]
        want[conv] = plain_windows([(role, n + 5) for role, n in turns], 400, 3, 100)
    got = {}
    for w in sorted(format_windows(frame(spark, rows), 400, 3, 100).collect(), key=lambda r: (r.conv_id, r.span, r.window)):
        head = w.first_turn > 0 and w.conv_id % 3 == 0
        got.setdefault(w.conv_id, []).append((w.first_turn - w.n_repeated + head, w.first_turn, w.first_turn + w.n_new, w.n_tokens))
    spans = {w.conv_id for w in format_windows(frame(spark, rows), 400, 3, 100).where("span > 0").collect()}
    assert len(spans) < 30 and all(got[c] == want[c] for c in want if c not in spans)


def test_a_long_system_turn_leaves_full_windows(spark):
    rows = [(1, 0, "system", "s " * 1600), *[(1, k, ["user", "assistant"][k % 2], "w " * 15) for k in range(1, 201)]]
    rows += [(2, k, ["user", "assistant"][k % 2], "w " * (10 + k % 90)) for k in range(6000)]
    windows = format_windows(frame(spark, rows)).collect()
    one, two = [w for w in windows if w.conv_id == 1], [w for w in windows if w.conv_id == 2]
    assert len(one) <= 10 and all(w.n_tokens <= 2048 for w in windows)
    assert np.mean([w.n_tokens for w in two]) > 0.9 * 2048 and all(w.n_repeated for w in two if w.first_turn)


def test_empty_table(spark):
    assert digest(format_windows(frame(spark, []))).count() == 0
