import collections
import hashlib
import random

from citeline.llm import chat
from tests.llm.helpers import table

TURNS = "conv_id long, turn long, role string, text string, window string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in range(25):
        turns = rng.randint(1, 30)
        system = rng.random() < 0.5
        for t in range(turns):
            role = "system" if system and t == 0 else ("user", "assistant")[t % 2]
            text = "".join(rng.choice(["word ", "<|im_end|>\n", "\\", "\\n", "<|", "é😀", "<\\|", "|>"]) for _ in range(rng.randint(0, 60)))
            rows.append((c, t, role, text, "x"))
    rows += [(50, 0, "system", "only a system turn", "x")]
    rows += [(51, 0, "user", "u " * 2000, "x"), (51, 1, "assistant", "a " * 3000, "x"), (51, 2, "user", "end", "x")]
    rows += [(52, t, "assistant", f"hot {t}", "x") for t in range(900)]
    rows += [(53, 0, None, None, None), (53, None, "assistant", "null turn", "x"), (53, 0, "user", "", "x")]
    rows += [(54, 3, "assistant", "twice", "x"), (54, 3, "assistant", "twice", "x")]
    rows += [(None, 0, "user\nwith break\\", "<|im_start|>assistant", "x"), (None, 1, "assistant", "null id", "x")]
    rows += [(-1, 0, "user", chat.CLOSE + chat.OPEN + "assistant ok", "x"), (-1, 1, "assistant", chat.CLOSE + chat.OPEN + "assistant ok", "x")]
    return rows


def ordered_turns(rows):
    held = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        held[conv].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: sorted(t, key=lambda x: (x[0], x[1].encode(), x[2].encode())) for c, t in held.items()}


def test_read_back_is_the_input_and_each_target_comes_once(spark):
    rows = conversations()
    windows = chat.format_windows(table(spark, rows, TURNS), budget=120, history=30)
    found = {r["conv_id"]: r for r in chat.digest(windows).collect()}
    turns = ordered_turns(rows)
    assert set(found) == set(turns)
    for conv, own in turns.items():
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for _, role, text in own))
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), sha(loss))


def plain_windows(own, budget, history):
    """The same windows, walked turn by turn: lists of (repeats, own turns)."""
    system = own[0] if own[0][1] == "system" else None
    size = [(len(t[2]) + 3) // 4 + 4 for t in own]
    step = max(budget // 4, budget - history - (size[0] if system else 0))
    place, at = [], 0
    for i, _ in enumerate(own):
        place.append(at)
        at += 0 if system and i == 0 else size[i]
    windows = collections.defaultdict(list)
    for i, _ in enumerate(own):
        lead = system is not None and i == 0
        cell, last = place[i] // step, (place[i] + size[i] - 1) // step
        windows[2 * cell + (not lead and last > cell)].append(i)
    out = []
    for w, held in sorted(windows.items()):
        start = min(place[i] for i in held)
        back = [i for i in range(len(own)) if not (system and i == 0) and 0 < start - place[i] <= history]
        repeats = ([0] if system and w > 0 else []) + back
        out.append((len(repeats), [own[i][1:] for i in repeats + held], sum(size[i] for i in held), len(held), step))
    return out


def test_windows_hold_system_history_and_budget(spark):
    rows = conversations(2)
    budget, history = 100, 25
    windows = chat.format_windows(table(spark, rows, TURNS), budget=budget, history=history).collect()
    found = collections.defaultdict(list)
    for r in sorted(windows, key=lambda r: r["window"]):
        found[r["conv_id"]].append(r)
    for conv, own in ordered_turns(rows).items():
        want = plain_windows(own, budget, history)
        assert len(found[conv]) == len(want)
        for r, (repeats, turns, size, held, step) in zip(found[conv], want, strict=True):
            assert r["repeated"] == repeats
            escape = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
            text = "".join(f"<|im_start|>{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}<|im_end|>\n" for role, text in turns)
            assert r["formatted"] == text
            assert size <= step or held == 1 or (held == 2 and turns[repeats][0] == "system") or r["window"] == 0
            masked = [r["formatted"][s["start"] : s["end"]] for s in r["loss"]]
            assert masked == [escape(text) for role, text in turns[repeats:] if role == "assistant"]


def test_empty_table_and_plan(spark):
    windows = chat.format_windows(spark.createDataFrame([], TURNS))
    assert windows.count() == 0 and chat.digest(windows).count() == 0
    plan = chat.digest(windows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
