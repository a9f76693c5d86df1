"""Transcript records for tests."""

import json


def stamp(second):
    """Half past eight on a summer morning, and so many seconds."""
    return f"2025-07-03T08:{30 + second // 60:02d}:{second % 60:02d}.000Z"


def record(second, kind="assistant", content=None, session="s1", cwd="/work/app", usage=None, **more):
    message = {"role": "user" if kind == "user" else "assistant"}
    if content is not None:
        message["content"] = content
    if usage:
        message["usage"] = usage
    return {"type": kind, "uuid": f"u{second}", "sessionId": session, "timestamp": stamp(second), "cwd": cwd, "version": "1", "message": message, **more}


def call(second, tool_id, name="Bash", more=None, **values):
    return record(second, content=[{"type": "tool_use", "id": tool_id, "name": name, "input": values}], **(more or {}))


def result(second, tool_id, content="ok", is_error=False, file=None, more=None):
    extra = {"toolUseResult": {"file": file}} if file else {}
    return record(second, "user", [{"type": "tool_result", "tool_use_id": tool_id, "content": content, "is_error": is_error}], **extra, **(more or {}))


def usage(n, read=0, create=0, output=5, tier="ephemeral_5m_input_tokens"):
    cache = {"cache_creation": {tier: create}} if tier else {}
    return {"input_tokens": n, "output_tokens": output, "cache_read_input_tokens": read, "cache_creation_input_tokens": create, **cache}


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records))
    return str(path)


def day():
    """Five calls, two seconds each, between questions and answers: 23 records."""
    out = [record(0, "user", "please tidy up"), record(1, content="looking", usage=usage(3, 2000, 40))]
    asked = {
        "g1": ("Glob", {"pattern": "**/*.py", "path": "/work/app"}),
        "w1": ("Write", {"file_path": "/work/app/new.py"}),
        "b1": ("Bash", {"command": "make check /srv/app"}),
        "r1": ("Read", {"file_path": "/work/app/new.py"}),
        "b2": ("Bash", {"command": "make clean"}),
    }
    for i, (ident, (name, values)) in enumerate(asked.items()):
        second = 4 * i + 2
        out += [call(second, ident, name, {"usage": usage(2, 2000 + second, 20)}, **values), result(second + 2, ident)]
        out.append(record(second + 3, content=f"step {i} done", usage=usage(2, 2000 + second, 20)))
    out += [record(22 + i, "progress") for i in range(6)]
    return out
