"""Builds transcript folders for tests: the same shapes that a runtime appends."""

from __future__ import annotations

import json
from pathlib import Path

SESSION = "0a0b0c0d-0003-4000-8000-000000000003"


def agent_id(n: int) -> str:
    return f"a{n:016x}"


class Transcript:
    """One session whose main transcript, children and journals grow."""

    def __init__(self, root: Path, session: str = SESSION, folder: str = "-work"):
        self.root, self.session, self.folder, self.n = Path(root), session, folder, 0
        self.main: list[str] = []
        self.files: dict[str, list[str]] = {}
        self.last: str | None = None

    def add(self, name: str, to: str | None = None, **fields) -> str:
        """A record with an id; its parent is the one before unless it is given."""
        fields = {"uuid": name, "parentUuid": self.last, "sessionId": self.session, **fields}
        self.raw(json.dumps(fields), to)
        if to is None:
            self.last = name
        return name

    def raw(self, line: str, to: str | None = None) -> None:
        (self.main if to is None else self.files.setdefault(to, [])).append(line)

    def at(self, second: int) -> str:
        return f"2026-02-{self.n:02d}T10:{second // 60:02d}:{second % 60:02d}.000Z"

    def says(self, name: str, call: str, content: list, stop: str | None, second: int, to: str | None = None, model: str = "m1", **more) -> str:
        usage = {"input_tokens": 2, "output_tokens": second, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 4}
        return self.add(name, to, type="assistant", timestamp=self.at(second), message={"id": call, "role": "assistant", "model": model, "stop_reason": stop, "content": content, "usage": usage}, **more)

    def result(self, name: str, tool: str, cycle: str, second: int, content="done", extra=None, **more) -> str:
        return self.add(name, type="user", promptId=cycle, timestamp=self.at(second), message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": tool, "content": content}]}, toolUseResult=extra if extra is not None else {"stdout": "done"}, **more)

    def turn(self, prompt: str, agent: bool = False) -> int:
        """A prompt, a call of two fragments with a tool, maybe a child that reports back, and an answer."""
        self.n += 1
        t = f"t{self.n}"
        self.add(f"{t}-in", type="user", promptId=f"{t}-run", origin={"kind": "human"}, timestamp=self.at(1), message={"role": "user", "content": [{"type": "text", "text": prompt}]})
        self.says(f"{t}-f1", f"{t}-call", [{"type": "text", "text": f"working on {self.n}"}], None, 2)
        self.says(f"{t}-f2", f"{t}-call", [{"type": "tool_use", "id": f"{t}-tool", "name": "Shell", "input": {"c": 1}}], "tool_use", 3)
        self.result(f"{t}-res", f"{t}-tool", f"{t}-run", 4)
        if agent:
            child = agent_id(self.n)
            to = f"{self.session}/subagents/agent-{child}.jsonl"
            self.says(f"{t}-spawn", f"{t}-spawncall", [{"type": "tool_use", "id": f"{t}-agent", "name": "Agent", "input": {}}], "tool_use", 5)
            self.result(f"{t}-ack", f"{t}-agent", f"{t}-run", 6, extra={"agentId": child, "status": "async_launched"})
            self.add(f"{t}-c1", to, type="user", parentUuid=None, promptId=f"{t}-crun", agentId=child, timestamp=self.at(7), message={"role": "user", "content": "help"})
            self.says(f"{t}-c2", f"{t}-ccall", [{"type": "text", "text": "helped"}], "end_turn", 8, to, parentUuid=f"{t}-c1", agentId=child)
            note = f"<task-notification>\n<task-id>{child}</task-id>\n<tool-use-id>{t}-agent</tool-use-id>\n</task-notification>"
            self.add(f"{t}-note", type="user", promptId=f"{t}-run2", origin={"kind": "task-notification"}, timestamp=self.at(30), message={"role": "user", "content": note})
        self.says(f"{t}-end", f"{t}-final", [{"type": "text", "text": f"turn {self.n} complete"}], "end_turn", 40)
        return self.n

    def compaction(self) -> None:
        self.n += 1
        t, before = f"t{self.n}", self.last
        self.add(f"{t}-cut", type="system", subtype="compact_boundary", parentUuid=None, logicalParentUuid=before, timestamp=self.at(2))
        self.add(f"{t}-sum", type="user", isCompactSummary=True, promptId=f"{t}-sumrun", timestamp=self.at(1), message={"role": "user", "content": "the work so far"})

    def workflow(self, children: int) -> None:
        self.n += 1
        t, run = f"t{self.n}", f"wf_{self.n}"
        self.says(f"{t}-wf", f"{t}-wfcall", [{"type": "tool_use", "id": f"{t}-wftool", "name": "Workflow", "input": {}}], "tool_use", 2)
        self.result(f"{t}-wfres", f"{t}-wftool", f"{t}-run", 3, extra={"runId": run, "status": "async_launched"})
        for i in range(children):
            child = agent_id(1000 * self.n + i)
            where = f"{self.session}/subagents/workflows/{run}"
            self.raw(json.dumps({"type": "started", "agentId": child}), f"{where}/journal.jsonl")
            self.says(f"{t}-w{i}", f"{t}-wcall{i}", [{"type": "text", "text": "part done"}], "end_turn", 5, f"{where}/agent-{child}.jsonl", parentUuid=None, agentId=child)

    def flush(self) -> str:
        """Writes all files; the root."""
        for name, lines in {f"{self.session}.jsonl": self.main, **self.files}.items():
            path = self.root / self.folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text("".join(f"{line}\n" for line in lines))
        return str(self.root)
