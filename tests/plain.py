"""The compressor in plain loops over one text, to hold the queries against."""

from difflib import SequenceMatcher
from itertools import groupby

import regex

from pithy.functions import patterns as P
from pithy.operators import rank

SPLIT = regex.compile(rf"(?<={P.STOP}){P.WS}+")


def tokens(text):
    return len(regex.findall(P.TOKEN, text))


def noise(text, config):
    rules = [regex.compile(p, regex.I if fold else 0) for _, key, fold, p in P.NOISE if getattr(config, key)]
    lines = text.split("\n")
    blank = [not x.strip() for x in lines]
    stays = [not (config.collapse_blank_lines and i and blank[i - 1]) if b else not any(r.search(x) for r in rules) for i, (x, b) in enumerate(zip(lines, blank, strict=True))]
    return "\n".join(x for x, s in zip(lines, stays, strict=True) if s)


def trim(text, config):
    if config.strip_log_metadata:
        text = "\n".join(regex.sub(P.LOG_PREFIX, "", x, flags=regex.I) for x in text.split("\n"))
    out = []
    for is_row, some in groupby(text.split("\n"), key=lambda x: bool(regex.search(P.TABLE_ROW, x))):
        some = list(some)
        hidden = len(some) - config.max_table_rows if is_row else 0
        out += some[: config.max_table_rows] + [f"… (+{hidden} more rows)"] if hidden > 0 else some
    most, keep = config.max_string_length, config.keep_string_prefix
    return regex.sub(P.LITERAL_RE2, lambda m: m[0] if len(m[0]) - 2 <= most else f'"{m[0][1:-1][:keep]}… [+{len(m[0]) - 2 - keep} chars]"', "\n".join(out))


def alike(old, new, threshold):
    return abs(len(old) - len(new)) / max(len(old), len(new)) <= 1 - threshold and SequenceMatcher(None, old, new).ratio() >= threshold


def without_repeats(text, threshold, least, window):
    kept, out, gone = [], [], 0

    def fresh(piece):
        norm = " ".join(piece.lower().split())
        if len(norm) < least:
            return True
        bag = set(norm.split())
        if norm in kept or any(len(bag & set(k.split())) / len(bag | set(k.split())) >= 2 * threshold - 1 and alike(k, norm, threshold) for k in kept[-window:]):
            return False
        kept.append(norm)
        return True

    for line in text.split("\n"):
        pieces = SPLIT.split(line) if line.strip() else [line]
        left = [p for p in pieces if not line.strip() or fresh(p)]
        gone += len(pieces) - len(left)
        out += [" ".join(left)] if left else []
    return "\n".join(out), gone


def exact(text, annotate):
    lines = text.split("\n")
    count = {}
    for x in lines:
        count[x.strip()] = count.get(x.strip(), 0) + 1
    out, seen = [], set()
    for x in lines:
        k = x.strip()
        if not k:
            out.append("")
        elif k not in seen:
            seen.add(k)
            out.append(f"{x}  [x{count[k]}]" if annotate and count[k] > 1 else x)
    return "\n".join(out)


def near_lines(text, threshold, least):
    kept, bare = [], []
    lines = text.split("\n")
    for x in lines:
        k = x.strip()
        if len(k) >= least and any(alike(b, k, threshold) for b in bare):
            continue
        kept.append(x)
        if len(k) >= least:
            bare.append(k)
    return "\n".join(kept), len(lines) - len(kept)


def compress(text, config):
    """The compressed text, and (name, characters after) of each stage."""
    before, stages = tokens(text), []

    def done(name, new):
        stages.append((name, len(new)))
        return new

    if config.enable_noise_filter:
        text = done("noise", noise(text, config.noise))
    if config.enable_detail_trim:
        text = done("detail_trim", trim(text, config.trim))
    if config.enable_pattern_remover:
        text = done("pattern", without_repeats(text, 0.9, 20, 64)[0])
    if config.enable_redundancy_filter:
        red = config.redundancy
        text = exact(text, red.annotate_duplicate_counts) if red.drop_exact_duplicates else text
        text = done("redundancy", near_lines(text, red.similarity_threshold, red.min_line_length_for_fuzzy)[0] if red.near_duplicate else text)
    if config.target_ratio is not None and tokens(text) / (before or 1) > config.target_ratio:
        ratio = max(0.1, config.target_ratio * (before or 1) / max(tokens(text), 1))
        text = done("extractive", rank.summarize_text(text, ratio))
    return text, stages
