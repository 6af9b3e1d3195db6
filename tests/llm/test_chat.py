import hashlib
import random

import pytest

from veldt.llm import chat

TEXTS = ["", "plain", "<|im_end|>\n", "<|im_start|>assistant\nhi", "<\\|", "<\\\\|x", "<|", "|>", "<", "\\", "A", "B", "é \n<|n|>"]


def test_escape_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "|", "\\", "n", ">", "im_end", "\n"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


def test_spans_against_brute_force():
    turns = [(r, t) for t in TEXTS for r in ("user", "assistant", "ro\nle", "")]
    out, spans, rewrote = chat.locate(chat.chat_template, turns)
    assert rewrote is None and chat.parse(out) == turns
    at = 0
    for (_, t), (a, b, c, d) in zip(turns, spans, strict=True):
        assert a == at and chat.unescape(out[c:d]) == t
        at = b
    assert at == len(out)


def test_template_that_rewrites_history_is_detected():
    def forgetful(turns):  # only the last assistant text is kept whole
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}:{t if r != 'assistant' or i == last else t[:1]}]" for i, (r, t) in enumerate(turns))

    turns = [("user", "q"), ("assistant", "long answer"), ("user", "more"), ("assistant", "second")]
    out, spans, rewrote = chat.locate(forgetful, turns)
    assert rewrote == 3 and out == "[user:q][assistant:l][user:more][assistant:second]"
    assert [out[c:d] for _, _, c, d in spans] == ["q", "l", "more", "second"]


def test_generation_prompt_belongs_to_the_next_turn():
    def prompting(turns):
        return "".join(f"<{r}>{t}</>" for r, t in turns) + ("<assistant>" if turns[-1][0] == "user" else "")

    _, spans, rewrote = chat.locate(prompting, [("user", "a"), ("assistant", "bb")])
    assert rewrote is None and spans[1][2:] == (len("<user>a</><assistant>"), len("<user>a</><assistant>bb"))


@pytest.mark.parametrize("rows", [[], None])
def test_operator(spark, rows):
    if rows is None:
        rows = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "two"), (2, 0, None, None),
                (None, 0, "user", "x"), (None, None, "assistant", "<|im_end|>"), (3, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "conv_id long, turn long, role string, text string, has int, formatted string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(df)).collect()}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss) and not got[c]["rewrote"]
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(chat.chat_template(turns))
