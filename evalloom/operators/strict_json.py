"""RFC 8259 validation that neither overflows the stack nor accepts more than the grammar."""

from __future__ import annotations

import json
import re

_SPACE = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"')
_SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null")


def _reject(name: str) -> None:
    raise ValueError(name)


#: Numbers stay text: a number of any length is valid, and Python's int() refuses very long ones.
_DECODER = json.JSONDecoder(parse_constant=_reject, parse_int=str, parse_float=str)


def fast_value(text: str):
    """The decoded value, numbers as text; ValueError if it isn't one JSON value, RecursionError if too deep."""
    return _DECODER.decode(text)


def is_object(text: str) -> bool:
    """Is the text exactly one JSON object?"""
    try:
        return isinstance(fast_value(text), dict)
    except ValueError:
        return False
    except RecursionError:
        return _walk_object(text)


def _walk_object(text: str) -> bool:
    """The grammar with its own stack, for values nested deeper than the decoder can follow."""
    skip = lambda i: _SPACE.match(text, i).end()
    i, stack, n = skip(0), [], len(text)
    if text[i : i + 1] != "{":
        return False
    expect = "value"
    while True:
        i = skip(i)
        if expect in ("value", "value_or_end"):
            if expect == "value_or_end" and text[i : i + 1] == "]":
                stack.pop()
                i, expect = i + 1, "after"
            elif text[i : i + 1] == "{":
                stack.append("}")
                i, expect = i + 1, "key_or_end"
            elif text[i : i + 1] == "[":
                stack.append("]")
                i, expect = i + 1, "value_or_end"
            else:
                hit = _STRING.match(text, i) or _SCALAR.match(text, i)
                if not hit:
                    return False
                i, expect = hit.end(), "after"
        elif expect in ("key", "key_or_end"):
            if expect == "key_or_end" and text[i : i + 1] == "}":
                stack.pop()
                i, expect = i + 1, "after"
            else:
                hit = _STRING.match(text, i)
                if not hit:
                    return False
                i = skip(hit.end())
                if text[i : i + 1] != ":":
                    return False
                i, expect = i + 1, "value"
        if expect == "after":
            i = skip(i)
            if not stack:
                return i == n
            if text[i : i + 1] == ",":
                i, expect = i + 1, "key" if stack[-1] == "}" else "value"
            elif text[i : i + 1] == stack[-1]:
                stack.pop()
                i += 1
            else:
                return False


def deep_value(text: str, number=float):
    """The value of JSON text nested deeper than the decoder can follow; ValueError if it isn't one JSON value.

    Containers are built on an own stack, so memory is the only bound. number makes a value of a number's text.
    """
    decode = json.JSONDecoder(parse_constant=_reject, parse_float=number).decode
    # (container, key that its next value gets)
    stack: list[list] = []
    i, n, done, value = _SPACE.match(text).end(), len(text), False, None
    while not done:
        ch = text[i : i + 1]
        if ch in ("{", "["):
            value, i = ({} if ch == "{" else []), _SPACE.match(text, i + 1).end()
            if text[i : i + 1] == ("}" if ch == "{" else "]"):
                i += 1
            else:
                stack.append([value, None])
                if ch == "[":
                    continue
                i = _key(text, i, stack)
                continue
        else:
            hit = _STRING.match(text, i) or _SCALAR.match(text, i)
            if not hit:
                raise ValueError(f"no value at {i}")
            value, i = decode(hit[0]), hit.end()
        while True:
            i = _SPACE.match(text, i).end()
            if not stack:
                done = True
                break
            holder, key = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            ch = text[i : i + 1]
            if ch == ",":
                i = _SPACE.match(text, i + 1).end()
                if isinstance(holder, dict):
                    i = _key(text, i, stack)
                break
            if ch != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"neither a comma nor an end at {i}")
            stack.pop()
            value, i = holder, i + 1
    if i != n:
        raise ValueError(f"more text at {i}")
    return value


def _key(text: str, i: int, stack: list[list]) -> int:
    """Read a key and its colon into the open object; the place of its value."""
    hit = _STRING.match(text, i)
    colon = _SPACE.match(text, hit.end()).end() if hit else i
    if not hit or text[colon : colon + 1] != ":":
        raise ValueError(f"no key at {i}")
    stack[-1][1] = json.loads(hit[0])
    return _SPACE.match(text, colon + 1).end()
