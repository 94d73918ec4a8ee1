"""Masks from a tokenizer file against tokenizing every prefix with the library itself."""

import zlib

import pytest

from trailframe.operators import token_spans
from trailframe.plans import training, views

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


def told(spark, rows, opener=""):
    df = spark.createDataFrame([(n, [(t, on) for t, on in r] if r is not None else None) for n, r in enumerate(rows)], "n int, segments array<struct<text:string,trained:boolean>>")
    return [r["spans"] for r in token_spans.prefix_spans(df, token_spans.FileTokenizer(PATH), opener=opener).orderBy("n").collect()]


def test_spans(spark, encode):
    rows = [
        [("user: hi\n", False), ("<think>so</think> yes.\n", True), ("user: more", False), (" fine", True)],
        [("a\n\n", False), ("b", True)],  # two line feeds are one token alone, two tokens before a word
        [("hel", False), ("lo", True)],  # one token together
        None,
        [],
        [(None, False), ("x <|endoftext|>", True)],
    ]
    a, b, c, none, empty, odd = told(spark, rows, "<think>")
    texts = [t for t, _ in rows[0]]
    ids = [encode("".join(texts[: k + 1])) for k in range(4)]
    opener = encode("<think>")
    assert ids[1][len(ids[0]) :][: len(opener)] == opener
    want = [0] * len(opener) + [1] * (len(ids[1]) - len(ids[0]) - len(opener)) + [0] * (len(ids[2]) - len(ids[1])) + [1] * (len(ids[3]) - len(ids[2]))
    assert (a["tokens"], a["mask"], a["prompt_length"], a["response_length"], a["error"]) == (ids[3], want, len(ids[0]), len(want), None)
    assert encode("a\n\n") != encode("a\n\nb")[: len(encode("a\n\n"))]
    assert b["error"] == c["error"] == "the tokens of prefix 0 change when text is appended" and b["tokens"] is None and c["mask"] is None
    assert none is None
    assert (empty["tokens"], empty["mask"], empty["prompt_length"]) == ([], [], 0)
    assert odd["tokens"] == encode("x <|endoftext|>") and 50256 not in odd["tokens"] and odd["prompt_length"] == 0


def test_query_of_spans(spark, encode):
    """Every step of the table, each prefix tokenized anew."""
    found = {(r["traj_id"], r["step_num"]): r for r in training.tokenizer_spans(spark, SF).collect()}
    steps = views.steps(spark, SF).where("response IS NOT NULL").collect()
    assert len(found) == len(steps) > 20
    opener = encode("<think>\n")
    errors = 0
    for s in steps:
        r = found[s["traj_id"], s["step_num"]]
        mark = "\n\n" if s["step_num"] % 3 == 1 else "\n"
        texts = [f"<|im_start|>user\n{s['observation']}<|im_end|>\n<|im_start|>assistant{mark}", f"<think>\n{s['response']}<|im_end|>\n" if mark == "\n" else f"{s['response']}<|im_end|>\n", "<|im_start|>user\nCompress.<|im_end|>\n<|im_start|>assistant\n", f"<memory>{s['step_num']}</memory><|im_end|>\n"]
        ids = [encode("".join(texts[: k + 1])) for k in range(4)]
        broken = [k for k in range(3) if ids[k + 1][: len(ids[k])] != ids[k]]
        errors += bool(broken)
        if broken:
            assert r["error"] == f"the tokens of prefix {broken[0]} change when text is appended" and r["n_tokens"] is None
            continue
        added = [len(b) - len(a) for a, b in zip(ids, ids[1:])]
        shut = len(opener) if ids[1][len(ids[0]) :][: len(opener)] == opener else 0
        runs = ",".join(f"{v}x{n}" for v, n in ((0, shut), (1, added[0] - shut), (0, added[1]), (1, added[2])) if n)
        assert (r["n_tokens"], r["prompt_length"], r["response_length"], r["runs"], r["error"]) == (len(ids[3]), len(ids[0]), sum(added), runs, None)
        assert r["ids_crc32"] == zlib.crc32(",".join(map(str, ids[3])).encode())
    assert 0 < errors < len(steps)


def test_query_of_accumulated_turns(spark, encode):
    """Turn by turn in plain Python: ids of earlier turns stay, newline and opener go between."""
    found = {r["conv_id"]: r for r in training.tokenizer_turns(spark, SF).collect()}
    rows = views.table(spark, SF, "conversations").where("role <> 'system'").orderBy("conv_id", "turn").collect()
    opener, (newline,) = encode("<|im_start|>assistant\n<think>\n"), encode("\n")
    want = {}
    for r in rows:
        c = want.setdefault(r["conv_id"], {"ids": [], "on": 0, "last": "", "failed": False})
        if c["failed"]:
            continue
        if r["role"] == "assistant":
            if c["last"] in ("", "assistant"):
                c["failed"] = True
                continue
            more = encode(r["text"] or "") + [50256]
            c["on"] += len(more)
        else:
            more = encode(f"<|im_start|>user\n{r['text'] or ''}<|im_end|>\n")
            gap = [newline] if c["last"] and c["ids"][-1] == 50256 else []
            more = gap + more + opener
        c["ids"], c["last"] = c["ids"] + more, r["role"]
    assert len(found) == len(want)
    for k, c in want.items():
        assert (found[k]["n"], found[k]["trained"], found[k]["ids_crc32"], found[k]["failed"]) == (len(c["ids"]), c["on"], zlib.crc32(",".join(map(str, c["ids"])).encode()), c["failed"])


def test_names(spark):
    made = token_spans.FileTokenizer(PATH)
    assert token_spans.newline_id(made) == 198 and made.id_of("<|endoftext|>") == 50256
    assert token_spans.FileTokenizer(PATH, specials=True)("a<|endoftext|>")[-1] == 50256
    with pytest.raises(ValueError):
        made.id_of("<|nothing|>")
    frame = spark.createDataFrame([("assistant", None, 1), ("user", "", 2)], "role string, text string, tokens int")
    ids = {r["role"]: r["ids"] for r in token_spans.turn_ids(frame, made, 50256).collect()}
    assert ids["assistant"] == [50256] and ids["user"] == made("<|im_start|>user\n<|im_end|>\n")
    assert token_spans.turn_ids(frame.limit(0), made, 50256).count() == 0
