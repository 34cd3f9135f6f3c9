"""Span columns: arrays of findings that live inside the row they came from.

Everything here is row-local, so a scan of any size needs no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from .text import constant, let, newline_count

# The struct starts with its position, so natural order is reading order.
FINDING = (
    "struct<start:int,end:int,pct:int,entity:string,label:string,"
    "rule:string,line:int,value:string>"
)
FINDINGS = f"array<{FINDING}>"
MATCH = "struct<start:int,end:int,line:int,value:string>"

# Arrays grow in blocks of this size, so that a text with very many matches
# costs time in proportion to their number.
BLOCK_BITS = 8
BLOCK = 1 << BLOCK_BITS
MARK, FENCE = "\x01", "\x02"
STRINGS = "array<string>"
NEAR = 96
# A text that is looked up by position is cut into runs of 2**RUN_BITS code points.
RUN_BITS = 10
RUN = 1 << RUN_BITS


def empty(kind: str) -> Column:
    return F.array().cast(kind)


def might_match(text: Column, needs: tuple[str, ...]) -> Column:
    """Cheap test: one of the literals that every match contains is there."""
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needs]) if needs else F.lit(True)


def folded(text: Column) -> Column:
    """The text without case, in the sense of patterns that ignore case."""
    return F.lower(F.upper(text))


def mark_for(text: Column) -> Column:
    """A string that the text does not hold and cannot form with an inserted copy.

    One control character, unless the text has it: then a run of it longer than any
    in the text, between two characters of another kind.
    """
    runs = F.regexp_extract_all(text, F.lit(MARK + "+"), F.lit(0))
    longest = F.array_max(F.transform(runs, F.length))
    fence = F.lit(FENCE)
    return F.when(
        F.contains(text, F.lit(MARK)),
        F.concat(fence, F.repeat(F.lit(MARK), longest + 1), fence),
    ).otherwise(F.lit(MARK))


def replacements(mark: Column) -> tuple[Column, Column]:
    """What ``cut`` puts in place of a match: without and with its first group."""
    return (
        F.concat(mark, F.lit("$0"), mark, mark),
        F.concat(mark, F.lit("$0"), mark, F.lit("$1"), mark),
    )


def cut(text: Column, pattern: str, mark: Column, replacement: Column) -> Column:
    """The text cut at its matches: gap, match, group, gap, match, group, ... gap.

    NULL when nothing matches.  One pass of the pattern puts marks around each match,
    which shows in the size of the text, and the text is split there.
    """
    return let(F.regexp_replace(text, F.lit(pattern), replacement), lambda m: F.when(
        F.octet_length(m) != F.octet_length(text), F.split(m, mark, -1)
    ))


def find_spans(text: Column, pattern: str, needs: tuple[str, ...] = ()) -> Column:
    """All non-overlapping matches of a pattern with code-point offsets and line."""
    pieces = F.when(might_match(text, needs), let(
        mark_for(text), lambda mark: cut(text, pattern, mark, replacements(mark)[0])
    ))
    return let(pieces, lambda p: F.when(p.isNull(), empty(f"array<{MATCH}>")).otherwise(
        locate(p, F.lit(0))
    ))


def locate(pieces: Column, tail: Column) -> Column:
    """Offsets and lines of the matches of a text that ``cut`` has taken apart.

    The running length of gaps and matches gives the offsets.  A group, where there
    is one, ends ``tail`` characters before its match.
    """
    def found(i, pos, line):
        """(end of the match, line of its start, the match) behind a gap that starts at ``pos``."""
        hit = F.get(pieces, i * 3 + 1)
        gap = F.get(pieces, i * 3)
        group = F.get(pieces, i * 3 + 2)
        value = F.when(group == "", hit).otherwise(group)
        stop = pos + F.length(gap) + F.length(hit)
        line = line + newline_count(gap)
        end = stop - tail
        lead = F.length(hit) - tail - F.length(value)
        return stop, line, F.struct(
            (end - F.length(value)).alias("start"), end.alias("end"),
            (line + newline_count(F.substring(hit, F.lit(1), lead))).alias("line"),
            value.alias("value"),
        )

    def step(acc, i):
        stop, line, match = found(i, acc["pos"], acc["line"])
        return F.struct(
            stop.alias("pos"), (line + newline_count(F.get(pieces, i * 3 + 1))).alias("line"),
            F.concat(acc["out"], F.array(match)).alias("out"),
        )

    def walk(first, last, pos, line):
        return F.aggregate(
            F.sequence(first, last),
            F.struct(pos.alias("pos"), line.alias("line"), empty(f"array<{MATCH}>").alias("out")),
            step,
        )

    def block_step(acc, b):
        inner = walk(b * BLOCK, F.least((b + 1) * BLOCK, matches) - 1, acc["pos"], acc["line"])
        return let(inner, lambda x: F.struct(
            x["pos"].alias("pos"), x["line"].alias("line"),
            F.concat(acc["out"], F.array(x["out"])).alias("out"),
        ))

    matches = ((F.size(pieces) - 1) / F.lit(3)).cast("int")
    init = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"),
                    empty(f"array<array<{MATCH}>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((matches - 1) / F.lit(BLOCK)).cast("int"))
    many = F.aggregate(blocks, init, block_step, lambda acc: F.flatten(acc["out"]))
    few = walk(F.lit(0), matches - 1, F.lit(0), F.lit(1))["out"]
    # most rules match once in a text
    single = F.array(found(F.lit(0), F.lit(0), F.lit(1))[2])
    return F.when(matches == 1, single).when(matches <= BLOCK, few).otherwise(many)


def runs_of(text: Column) -> Column:
    """The text in runs of ``RUN`` code points: a position is found in its run, not from the start of the text."""
    return F.when(F.length(text) <= RUN, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    )


def stretch(runs: Column, start: Column, stop: Column) -> Column:
    """Characters from ``start`` up to ``stop`` of a text cut by ``runs_of``; takes time for their number and a run."""
    first, last = F.shiftright(start, RUN_BITS), F.shiftright(stop - 1, RUN_BITS)
    offset = start - first * RUN + 1
    inside = F.coalesce(F.substring(F.get(runs, first), offset, stop - start), F.lit(""))
    across = F.concat(
        F.substring(F.get(runs, first), offset, F.lit(RUN)),
        F.array_join(F.slice(runs, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(F.get(runs, last), F.lit(1), stop - last * RUN),
    )
    return F.when(first >= last, inside).otherwise(across)


def near_words(text: Column, runs: Column, matches: Column, words: Column, window: int) -> Column:
    """Per match whether one of ``words`` is among the last ``window`` word tokens before it; matches in order.

    ``runs`` is the text cut by ``runs_of``.  A short stretch before the match settles most, without tokens
    where it holds none of the words in any form.  Where a stretch is too short to hold the window, the
    tokens of the text are made once and walked along together with the matches.
    """
    token = r"(?U)\w+"
    # words behind blanks are tokens of their own: more than the window of them
    enough = rf"(?:[A-Za-z0-9_][^ \n]*+[ \n][^A-Za-z0-9_]*+){{{window}}}[A-Za-z0-9_]"

    def one(m):
        def by_tokens(before):
            return let(F.regexp_extract_all(before, F.lit(token), F.lit(0)), lambda found: F.when(
                (m["start"] <= NEAR) | (F.size(found) > window),
                F.arrays_overlap(F.slice(F.reverse(found), 1, window), words),
            ))

        def settled(before):
            absent = ~F.exists(words, lambda w: F.contains(before, w))
            return F.when(
                absent & ((m["start"] <= NEAR) | before.rlike(enough)), F.lit(False)
            ).otherwise(by_tokens(before))

        return let(F.lower(stretch(runs, F.greatest(m["start"] - NEAR, F.lit(0)), m["start"])), settled)

    def walked():
        # a match comes before a token that starts at the same place
        items = F.sort_array(F.concat(
            F.transform(matches, lambda m: F.struct(m["start"].alias("at"), F.lit(0).alias("kind"), F.lit("").alias("word"))),
            F.transform(find_spans(text, token), lambda t: F.struct(
                t["start"].alias("at"), F.lit(1).alias("kind"), t["value"].alias("word"),
            )),
        ))
        kind = "array<struct<at:int,kind:int,word:string>>"

        def step(last, x):
            # the token that the match starts in counts as far as it goes
            hit = F.exists(last, lambda t: F.array_contains(words, F.lower(F.substring(t["word"], F.lit(1), x["at"] - t["at"]))))
            kept = F.when(F.size(last) < window, last).otherwise(F.slice(last, F.lit(2), F.lit(window)))
            return F.when(x["kind"] == 0, F.struct(last.alias("state"), hit.alias("piece"))).otherwise(
                F.struct(F.concat(kept, F.array(x)).alias("state"), F.lit(None).cast("boolean").alias("piece"))
            )

        return F.filter(walk_blocks(items, empty(kind), step, "boolean"), lambda hit: hit.isNotNull())

    return let(F.transform(matches, one), lambda found: F.when(
        F.exists(found, lambda hit: hit.isNull()), walked()
    ).otherwise(found))


def longest_number(text: Column) -> Column:
    """Length of the longest run of digits, 0 when there are no two in a row."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)\d{2,}"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def matched_rules(text: Column, rules) -> Column:
    """Per rule that matches: its number and the text cut at its matches.

    Patterns are literals, so each is compiled once per task; only one cut text per
    matching rule is held at a time next to the text itself.  Rules that need a run
    of digits are settled by one look at the longest run.
    """
    def all_rules(facts):
        def pieces(number, rule):
            group = getattr(rule, "group", 0)
            found = cut(text, rule.pattern, facts["mark"], facts["with_group" if group else "alone"])
            tests = [
                might_match(where, literals)
                for where, literals in ((text, rule.needs), (facts["folded"], rule.needs_folded))
                if literals
            ]
            if getattr(rule, "digits", 0):
                tests.append(facts["longest"] >= rule.digits)
            if tests:
                found = F.when(reduce(and_, tests), found)
            return F.struct(F.lit(number).alias("no"), found.alias("pieces"))

        return F.filter(
            F.array(*[pieces(no, r) for no, r in enumerate(rules)]), lambda p: p["pieces"].isNotNull()
        )

    def facts(mark):
        alone, with_group = replacements(mark)
        return F.struct(
            mark.alias("mark"), alone.alias("alone"), with_group.alias("with_group"),
            (longest_number(text) if by_digits else F.lit(0)).alias("longest"),
            (folded(text) if by_folded else F.lit("")).alias("folded"),
        )

    if any(getattr(r, "group", 0) > 1 for r in rules):
        raise ValueError("the masked group of a rule must be its first")
    by_digits = any(getattr(r, "digits", 0) for r in rules)
    by_folded = any(r.needs_folded for r in rules)
    return let(let(mark_for(text), facts), all_rules)


def with_once(df: DataFrame, into: str, value: Column) -> DataFrame:
    """Add a costly column so that it is computed once per row.

    The optimizer copies the expression of a plain column into every filter on it;
    it does not look through a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(into))


def rule_findings(text: Column, rules, boost: int = 35, window: int = 5) -> Column:
    """Findings of all rules in rule order, with the context boost applied."""
    if not rules:
        return empty(FINDINGS)
    table = constant(
        [{"pct": r.pct, "entity": r.entity, "label": r.label, "rule": r.rule, "tail": r.tail,
          "context": r.context} for r in rules],
        "array<struct<pct:int,entity:string,label:string,rule:string,tail:int,context:array<string>>>",
    )
    boosted = boost and any(r.context and r.pct < 100 for r in rules)

    def of_rule(hit, runs):
        def findings(rule):
            def finding(m, pct):
                return F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), pct.alias("pct"),
                    rule["entity"].alias("entity"), rule["label"].alias("label"),
                    rule["rule"].alias("rule"), m["line"].alias("line"), m["value"].alias("value"),
                )

            def raised(matches):
                near = F.when(
                    (rule["pct"] < 100) & (F.size(rule["context"]) > 0), near_words(text, runs, matches, rule["context"], window)
                )
                return let(near, lambda near: F.transform(matches, lambda m, i: finding(
                    m, F.when(F.get(near, i), F.least(rule["pct"] + boost, F.lit(100))).otherwise(rule["pct"])
                )))

            matches = locate(hit["pieces"], rule["tail"])
            return let(matches, raised) if boosted else F.transform(matches, lambda m: finding(m, rule["pct"]))

        return let(F.get(table, hit["no"]), findings)

    def of_all(runs):
        return F.flatten(F.transform(matched_rules(text, rules), lambda hit: of_rule(hit, runs)))

    # the runs of a text are the same for all rules
    return (let(runs_of(text), of_all) if boosted else of_all(None)).cast(FINDINGS)


def resolve_overlaps(findings: Column) -> Column:
    """Keep the best of overlapping findings; the result is in reading order.

    Best first: score down, start up, length down, entity, rule.  A finding stays
    when it overlaps none kept before it; touching spans do not overlap.  Findings
    are first cut into runs that share no character, so the pairwise test only
    happens within a run.
    """
    return let(findings, _resolve)


def _resolve(findings: Column) -> Column:
    rank_type = f"struct<score:int,at:int,len:int,entity:string,rule:string,found:{FINDING}>"
    ranked = F.sort_array(F.transform(findings, lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"),
        F.struct(
            (-f["pct"]).alias("score"), f["start"].alias("at"),
            (f["start"] - f["end"]).alias("len"), f["entity"].alias("entity"),
            f["rule"].alias("rule"), f.alias("found"),
        ).cast(rank_type).alias("rank"),
    )))
    def keep(kept, candidate):
        f = candidate["found"]
        clash = F.exists(kept, lambda k: (k["start"] < f["end"]) & (k["end"] > f["start"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(f)))

    def best_of(run):
        return F.when(F.size(run) <= 1, F.transform(run, lambda r: r["found"])).otherwise(
            F.aggregate(F.sort_array(run), empty(FINDINGS), keep)
        )

    def step(reach, x):
        """A run opens where nothing before reaches."""
        opens = x["start"] >= reach
        return F.struct(
            F.when(opens, x["end"]).otherwise(F.greatest(reach, x["end"])).alias("state"), opens.alias("piece")
        )

    def by_runs(ordered):
        def of_runs(starts):
            def run_at(begin, r):
                behind = F.coalesce(F.get(starts, r + 1), F.size(ordered))
                return F.transform(F.slice(ordered, begin + 1, behind - begin), lambda x: x["rank"])

            each = F.transform(starts, lambda begin, r: let(run_at(begin, r), best_of))
            return F.when(F.size(starts) == F.size(ordered), F.sort_array(findings)).otherwise(F.sort_array(F.flatten(each)))

        # the walk carries positions alone: a state is copied at every step, with all that it holds
        opened = walk_blocks(
            F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.lit(-1), step, "boolean"
        )
        numbers = F.sequence(F.lit(0), F.size(ordered) - 1)
        return let(let(opened, lambda o: F.filter(numbers, lambda i: (i == 0) | F.get(o, i))), of_runs)

    return F.when(F.size(findings) <= 1, findings).otherwise(let(ranked, by_runs))


def walk_blocks(items: Column, state: Column, step, kind: str) -> Column:
    """Walk along an array with a small state; ``step(state, item)`` gives a struct (state, piece).

    The pieces, of type ``kind``, are gathered in blocks, so that the time is in proportion to their number.
    """
    def along(array):
        def one(acc, i):
            return let(step(acc["state"], F.get(array, i)), lambda x: F.struct(
                x["state"].alias("state"), F.concat(acc["out"], F.array(x["piece"])).alias("out"),
            ))

        def block(acc, b):
            inside = F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(array)) - 1)
            init = F.struct(acc["state"].alias("state"), empty(f"array<{kind}>").alias("out"))
            return let(F.aggregate(inside, init, one), lambda x: F.struct(
                x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out"),
            ))

        blocks = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / F.lit(BLOCK)).cast("int"))
        init = F.struct(state.alias("state"), empty(f"array<array<{kind}>>").alias("out"))
        return F.when(F.size(array) == 0, empty(f"array<{kind}>")).otherwise(
            F.aggregate(blocks, init, block, lambda acc: F.flatten(acc["out"]))
        )

    return let(items, along)


def splice(text: Column, findings: Column, marks: Column) -> Column:
    """Replace each span by its mark; findings in reading order, marks alongside.

    The text between the spans is taken out of its runs, so the time grows with the text and the spans.
    """
    def pieces(runs):
        gaps = F.transform(findings, lambda f, i: stretch(
            runs, F.when(i == 0, F.lit(0)).otherwise(F.get(findings, i - 1)["end"]), f["start"],
        ))
        body = F.array_join(F.zip_with(gaps, marks, lambda gap, mark: F.concat(gap, mark)), "")
        return F.concat(body, stretch(runs, F.element_at(findings, -1)["end"], F.length(text)))

    return F.when(F.size(findings) == 0, text).otherwise(let(runs_of(text), pieces))
