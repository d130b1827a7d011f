"""Token evidence read token by token in plain Python, to hold the expressions against."""

import re


def plain(token) -> str:
    """A token without the marks that tokenizers put for blanks and line breaks."""
    return str(token).replace("Ġ", " ").replace("▁", " ").replace("Ċ", "\n")


def tag_span(tokens: list[str], tag: str) -> tuple[int, int] | None:
    """Range of tokens between <tag> and </tag>; either mark may be cut into up to three."""
    up = [t.upper() for t in tokens]

    def mark(i: int, start: str) -> int | None:
        """How many tokens from i on hold the mark."""
        whole = start + tag
        if f"{whole}>" in up[i]:
            return 1
        two, three = up[i + 1 : i + 2], up[i + 2 : i + 3]
        if three and start in up[i] and tag in two[0] and ">" in three[0]:
            return 3
        if two and start == "<" and start in up[i] and tag in two[0] and ">" in two[0]:
            return 2
        if two and whole in up[i] and ">" in two[0]:
            return 2
        return None

    first = next(((i, n) for i in range(len(up)) if (n := mark(i, "<"))), None)
    if first is None:
        return None
    begin = first[0] + first[1]
    end = next((j for j in range(begin, len(up)) if mark(j, "</")), None)
    return None if end is None else (begin, end)


def single(found: list[tuple[int, str]], probs, method: str):
    letters = {x for _, x in found}
    if len(letters) == 1:
        return found[0][1], float(probs[found[0][0]]), method
    return ("", None, "token_multi") if letters else None


def token_answer(tokens: list[str], probs) -> tuple[str, float | None, str]:
    """One letter in the ANS span, else at the head before the first ``<``."""
    span = tag_span(tokens, "ANS")
    if span:
        hits = [(i, m.group()) for i in range(*span) if (m := re.search("[A-D]", tokens[i].upper()))]
        if got := single(hits, probs, "token_ans_span"):
            return got
    head = next((i for i, t in enumerate(tokens) if "<" in t), len(tokens))
    hits = [(i, m.group(1)) for i in range(head) if (m := re.match(r"\s*([A-D])\b", tokens[i].upper()))]
    return single(hits, probs, "token_prefix") or ("", None, "token_none")


def token_options(tokens: list[str], probs, options: list[tuple[str, list[str]]]) -> tuple[str, float | None, str]:
    """The option whose verb and noun words are among the tokens: both are asked for where
    options share a verb or noun, else either; confidence is the mean over first hits."""
    if not options:
        return "", None, "token_verbnoun_no_options"
    first: dict[str, int] = {}
    for i, t in enumerate(tokens):
        for w in re.findall("[a-z0-9]+", t.lower()):
            first.setdefault(w, i)
    verbs, nouns = [v for v, _ in options], [" ".join(n) for _, n in options]
    shared = len(set(verbs)) < len(verbs) or len(set(nouns)) < len(nouns)
    hits = []
    for i, (v, n) in enumerate(options[:4]):
        a, b = bool(v) and v in first, bool(n) and all(w in first for w in n)
        if (a and b) if shared else (a or b):
            hits.append(i)
    if len(hits) != 1:
        return "", None, "token_verbnoun_ambiguous"
    v, n = options[hits[0]]
    used = [float(probs[first[w]]) for w in ([v] if v else []) + list(n) if w in first]
    return "ABCD"[hits[0]], sum(used) / len(used) if used else None, "token_verbnoun_and" if shared else "token_verbnoun_or"


def evidence(tokens, probs, options) -> tuple:
    """A row of SCHEMA; options are structs of verb and noun words."""
    none = (None, "", None, "token_none", "", None, "token_verbnoun_none")
    if tokens is None or probs is None or len(tokens) == 0 or len(tokens) != len(probs):
        return none
    t = [plain(x) for x in tokens]
    span = tag_span(t, "STATE")
    state = next((float(probs[i]) for i in range(*span) if any(c.isalnum() for c in t[i])), None) if span else None
    pairs = [(o["verb"], list(o["noun"])) for o in options] if options is not None else []
    return (state, *token_answer(t, probs), *token_options(t, probs, pairs))
