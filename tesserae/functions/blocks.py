"""Which lines of a Markdown text are code: its block structure, without rendering.

Containers (quotes and list items) decide whether an indented line is code, a list that goes on
or a lazy paragraph line, so that no pattern on single lines can tell.  A text's lines are taken
in order with a stack of open containers.
"""

from __future__ import annotations

import re

FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
BULLET = re.compile(r"([-+*])(?=[ \t]|$)")
NUMBER = re.compile(r"(\d{1,9})[.)](?=[ \t]|$)")
RULE = re.compile(r"([-_*])[ \t]*(?:\1[ \t]*){2,}$")
HEADING = re.compile(r"#{1,6}(?:[ \t]|$)")
UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")


def _indent(line: str, at: int, column: int) -> tuple[int, int]:
    """Where the next visible character of a line is, and its column (tabs go on to the next fourth)."""
    while at < len(line) and line[at] in " \t":
        column += 4 - column % 4 if line[at] == "\t" else 1
        at += 1
    return at, column


def code_starts(text: str | None) -> list[int] | None:
    """For every line (split at line feeds) the first line of the code block it is in, or -1.

    Fenced blocks are code with both fences, up to the end of their container if never closed;
    indented blocks up to their last line that isn't blank.  Null text has no lines.
    """
    if text is None:
        return None
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    out = [-1] * len(lines)
    last = len(lines) - (lines[-1] == "")  # a final line feed begins no line
    stack: list[int] = []  # open containers: -1 a quote, else the column an item's content begins at
    leaf, begin, mark, end = "", 0, "", 0  # nothing, paragraph, fence or code; of code its first line, of a fence its mark, of indented code its last line

    for ln in range(last):
        line, base, depth = lines[ln], 0, 0
        at, column = _indent(line, 0, 0)
        for content in stack:  # containers that go on in this line
            if content < 0:
                if at < len(line) and line[at] == ">" and column - base < 4:
                    base = column + 1
                    at, column = _indent(line, at + 1, base)
                    base += column > base  # one space belongs to the mark
                else:
                    break
            elif at == len(line):
                pass
            elif column >= base + content:
                base += content
            else:
                break
            depth += 1
        blank, all_on = at == len(line), depth == len(stack)

        if leaf == "fence":
            if all_on:
                out[ln] = begin
                closes = column - base < 4 and line[at:].rstrip(" \t")
                if closes and len(closes) >= len(mark) and not closes.strip(mark[0]):
                    leaf = ""
                continue
            leaf = ""
        if leaf == "code":
            if all_on and (blank or column - base >= 4):
                if not blank:
                    out[end + 1 : ln + 1] = [begin] * (ln - end)
                    end = ln
                continue
            leaf = ""

        if blank:
            leaf = ""
            del stack[depth:]
            continue
        para = leaf == "paragraph"  # which may go on without its containers' marks
        opened = False
        while True:  # new blocks, from the outside in
            rest, inner = line[at:], column - base
            if inner >= 4:
                if not para:
                    if not opened:
                        del stack[depth:]
                    leaf, begin, end = "code", ln, ln
                    out[ln] = ln
                break
            if para and all_on and UNDERLINE.match(rest):
                leaf = ""
                break
            fence = FENCE.match(rest)
            plain = fence or HEADING.match(rest) or RULE.match(rest)
            quote = not plain and rest.startswith(">")
            item = None if plain or quote else BULLET.match(rest) or NUMBER.match(rest)
            if item and para and all_on:  # only an item with text, of a bullet or the number 1, ends a paragraph
                goes_on = not rest[item.end() :].strip(" \t") or (item[1].isdigit() and int(item[1]) != 1)
                item = None if goes_on else item
            if not (plain or quote or item):
                if not para:
                    if not opened:
                        del stack[depth:]
                    leaf = "paragraph"
                break
            if not opened:
                del stack[depth:]
            opened, para, leaf = True, False, ""
            if plain:
                if fence:
                    leaf, begin, mark = "fence", ln, fence[1] or fence[3]
                    out[ln] = ln
                break
            if quote:
                stack.append(-1)
                base = column + 1
                at, column = _indent(line, at + 1, base)
                base += column > base
            else:
                width = item.end()
                after, there = _indent(line, at + width, column + width)
                gap = there - column - width
                content = width + (1 if after == len(line) or gap > 4 else gap)
                stack.append(column - base + content)
                at, column, base = after, there, column + content
            if at == len(line):
                break
    return out
