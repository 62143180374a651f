"""Events from the stack traces of five languages.

Each extractor takes the whole text of a record.  It splits the text once and
works on line positions: where the trace starts, where it stops, and which lines
in between are frames.  All positions are 0-based, as lambdas over arrays see
them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import patterns as P
from faultline.functions.text import group, let, line_number, trim_blank_left, trim_space
from faultline.schema import EVENT, EXCEPTION, FRAME


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _positions(lines: Column) -> Column:
    return F.sequence(F.lit(0), F.size(lines) - 1)


def _first_position(
    lines: Column, positions: Column, test: Callable[[Column], Column]
) -> Column:
    """First position that passes ``test``; NULL when none does."""
    hit = F.filter(positions, lambda i: F.coalesce(test(i), F.lit(False)))
    return F.try_element_at(hit, F.lit(1))


def _line(lines: Column, position: Column) -> Column:
    """Line at a position, NULL past the end."""
    return F.get(lines, position)


def _frame(
    filename: Column, function: Column, line: Column, context: Column | None = None
) -> Column:
    shown = F.lit(None).cast("string") if context is None else context
    return F.struct(filename, function, line, shown).cast(FRAME)


def _trace_event(
    language: str, kind: Column, value: Column, message: Column, frames: Column
) -> Column:
    exception = F.struct(kind, value, F.struct(frames)).cast(EXCEPTION)
    missing = F.lit(None)
    return F.struct(
        F.lit(language),
        F.lit(language),
        F.lit("error"),
        message,
        missing,
        missing,
        missing,
        missing,
        exception,
        missing,
    ).cast(EVENT)


def _between(positions: Column, start: Column, stop: Column) -> Column:
    return F.filter(positions, lambda i: (i > start) & (i < stop))


def _scan(
    text: Column,
    gate: Column,
    start_test: Callable[[Column], Callable[[Column], Column]],
    build: Callable[[Column, Column, Column], Column],
) -> Column:
    """``build(lines, positions, start)`` for texts that pass gate and start."""

    def with_lines(lines: Column) -> Column:
        def with_positions(positions: Column) -> Column:
            start = _first_position(lines, positions, start_test(lines))
            return let(
                start,
                lambda s: F.when(s.isNotNull(), build(lines, positions, s)),
            )

        return let(_positions(lines), with_positions)

    return F.when(gate, let(_lines(text), with_lines))


def python_event(text: Column) -> Column:
    """EVENT of a Python traceback, NULL without frames and exception line."""

    def is_frame(line: Column) -> Column:
        return line.rlike(P.PY_FRAME)

    def build(lines: Column, positions: Column, start: Column) -> Column:
        later = F.filter(positions, lambda i: i > start)
        ending = _first_position(
            lines, later, lambda i: _line(lines, i).rlike(P.PY_EXCEPTION)
        )

        def frame(i: Column) -> Column:
            line, below = _line(lines, i), _line(lines, i + 1)
            context = F.when(
                below.startswith("    ") & ~is_frame(below),
                F.nullif(trim_space(below), F.lit("")),
            )
            return _frame(
                group(line, P.PY_FRAME, 1),
                group(line, P.PY_FRAME, 3),
                line_number(group(line, P.PY_FRAME, 2)),
                context,
            )

        def finish(end: Column) -> Column:
            stop = F.coalesce(end, F.size(lines))
            at = F.filter(
                _between(positions, start, stop), lambda i: is_frame(_line(lines, i))
            )
            last = _line(lines, end)
            kind = F.coalesce(group(last, P.PY_EXCEPTION, 1), F.lit(""))
            value = F.coalesce(group(last, P.PY_EXCEPTION, 2), F.lit(""))
            message = F.when(
                end.isNotNull(), F.concat(kind, F.lit(": "), value)
            ).otherwise(trim_space(_line(lines, F.lit(0))))
            return F.when(
                end.isNotNull() | (F.size(at) > 0),
                _trace_event("python", kind, value, message, F.transform(at, frame)),
            )

        return let(ending, finish)

    return _scan(
        text,
        F.contains(text, F.lit(P.PY_MARKER)),
        lambda lines: lambda i: F.contains(_line(lines, i), F.lit(P.PY_MARKER)),
        build,
    )


def java_event(text: Column) -> Column:
    """EVENT of a JVM throwable whose header is followed by a frame."""

    def is_frame(line: Column) -> Column:
        return line.rlike(P.JAVA_FRAME)

    def starts(lines: Column) -> Callable[[Column], Column]:
        return lambda i: _line(lines, i).rlike(P.JAVA_HEADER) & is_frame(
            _line(lines, i + 1)
        )

    def ends(line: Column) -> Column:
        def is_filler(body: Column) -> Column:
            return (
                body.startswith("...")
                | body.startswith("Caused by:")
                | body.startswith("Suppressed:")
                | (body == "")
            )

        return ~is_frame(line) & ~let(trim_space(line), is_filler)

    def build(lines: Column, positions: Column, start: Column) -> Column:
        stop = F.coalesce(
            _first_position(
                lines, positions, lambda i: (i > start) & ends(_line(lines, i))
            ),
            F.size(lines),
        )

        def frame(i: Column) -> Column:
            line = _line(lines, i)
            return _frame(
                group(line, P.JAVA_FRAME, 2),
                group(line, P.JAVA_FRAME, 1),
                line_number(group(line, P.JAVA_FRAME, 3)),
            )

        def finish(end: Column) -> Column:
            at = F.filter(
                _between(positions, start, end), lambda i: is_frame(_line(lines, i))
            )
            header = _line(lines, start)
            kind = group(header, P.JAVA_HEADER, 1)
            value = group(header, P.JAVA_HEADER, 2)
            message = F.concat_ws(": ", kind, F.nullif(value, F.lit("")))
            return _trace_event("java", kind, value, message, F.transform(at, frame))

        return let(stop, finish)

    gate = text.rlike("Exception|Error|Throwable") & F.contains(text, F.lit("at"))
    return _scan(text, gate, starts, build)


def go_event(text: Column) -> Column:
    """EVENT of a Go panic or fatal error; every later call line is a frame."""

    def build(lines: Column, positions: Column, start: Column) -> Column:
        def frame(i: Column) -> Column:
            below = F.coalesce(_line(lines, i + 1), F.lit(""))
            return _frame(
                group(below, P.GO_FILE, 1),
                group(_line(lines, i), P.GO_FUNC, 1),
                line_number(group(below, P.GO_FILE, 2)),
            )

        at = F.filter(
            positions, lambda i: (i > start) & _line(lines, i).rlike(P.GO_FUNC)
        )
        header = _line(lines, start)
        value = group(header, P.GO_HEADER, 2)
        kind = F.when(header.startswith("fatal error"), "FatalError").otherwise("PanicError")
        message = F.concat(F.lit("panic: "), value)
        return _trace_event("go", kind, value, message, F.transform(at, frame))

    gate = F.contains(text, F.lit("panic:")) | F.contains(text, F.lit("fatal error:"))
    return _scan(
        text, gate, lambda lines: lambda i: _line(lines, i).rlike(P.GO_HEADER), build
    )


def node_event(text: Column) -> Column:
    """EVENT of a V8 stack whose header is followed by a frame."""

    def is_frame(line: Column) -> Column:
        return line.rlike(P.NODE_FRAME) | line.rlike(P.NODE_ANONYMOUS)

    def starts(lines: Column) -> Callable[[Column], Column]:
        return lambda i: trim_blank_left(_line(lines, i)).rlike(P.NODE_HEADER) & is_frame(
            _line(lines, i + 1)
        )

    def ends(line: Column) -> Column:
        return ~is_frame(line) & ~line.startswith("    at ") & ~line.startswith("\tat ")

    def build(lines: Column, positions: Column, start: Column) -> Column:
        stop = F.coalesce(
            _first_position(
                lines, positions, lambda i: (i > start) & ends(_line(lines, i))
            ),
            F.size(lines),
        )

        def frame(i: Column) -> Column:
            line = _line(lines, i)
            return F.when(
                line.rlike(P.NODE_FRAME),
                _frame(
                    group(line, P.NODE_FRAME, 2),
                    group(line, P.NODE_FRAME, 1),
                    line_number(group(line, P.NODE_FRAME, 3)),
                ),
            ).otherwise(
                _frame(
                    group(line, P.NODE_ANONYMOUS, 1),
                    F.lit("<anonymous>"),
                    line_number(group(line, P.NODE_ANONYMOUS, 2)),
                )
            )

        def finish(end: Column) -> Column:
            at = F.filter(
                _between(positions, start, end), lambda i: is_frame(_line(lines, i))
            )
            header = trim_blank_left(_line(lines, start))
            kind = group(header, P.NODE_HEADER, 1)
            value = group(header, P.NODE_HEADER, 2)
            message = F.concat(kind, F.lit(": "), value)
            return _trace_event("node", kind, value, message, F.transform(at, frame))

        return let(stop, finish)

    gate = F.contains(text, F.lit("Error:")) & F.contains(text, F.lit("at"))
    return _scan(text, gate, starts, build)


def ruby_event(text: Column) -> Column:
    """EVENT of a Ruby exception; the header line is frame 0."""

    def build(lines: Column, positions: Column, start: Column) -> Column:
        stop = F.coalesce(
            _first_position(
                lines,
                positions,
                lambda i: (i > start) & ~_line(lines, i).rlike(P.RUBY_FRAME),
            ),
            F.size(lines),
        )

        def frame(pattern: str) -> Callable[[Column], Column]:
            return lambda line: _frame(
                group(line, pattern, 1),
                group(line, pattern, 3),
                line_number(group(line, pattern, 2)),
            )

        header = _line(lines, start)
        callers = let(stop, lambda end: F.slice(lines, start + 2, end - start - 1))
        frames = F.concat(
            F.array(frame(P.RUBY_HEADER)(header)),
            F.transform(callers, frame(P.RUBY_FRAME)),
        )
        kind = group(header, P.RUBY_HEADER, 5)
        value = group(header, P.RUBY_HEADER, 4)
        message = F.concat(kind, F.lit(": "), value)
        return _trace_event("ruby", kind, value, message, frames)

    return _scan(
        text,
        F.contains(text, F.lit(":in `")),
        lambda lines: lambda i: _line(lines, i).rlike(P.RUBY_HEADER),
        build,
    )
