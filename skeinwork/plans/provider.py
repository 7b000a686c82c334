"""Where verdicts come from: recorded ones by default, a live service only if one is named."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Protocol


class Refused(Exception):
    """No verdict came; the window is left for a later run."""


@dataclass(frozen=True)
class Reply:
    content: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    cost: float = 0.0


class Provider(Protocol):
    model: str

    def complete(self, system: str, user: str, schema: dict) -> Reply: ...


@dataclass(frozen=True)
class Replay:
    """Answers from recorded texts, by what is asked; anything else is refused."""

    model: str
    answers: dict[str, str]

    def complete(self, system: str, user: str, schema: dict) -> Reply:
        if user not in self.answers:
            raise Refused("not recorded")
        return Reply(self.answers[user])


def read_reply(body: str) -> Reply:
    """The first choice's text and the usage; an error, or a text that is blank, is no reply."""
    found = json.loads(body)
    if found.get("error"):
        raise ValueError(str(found["error"]))
    choices = found.get("choices") or [{}]
    content = (choices[0].get("message") or {}).get("content")
    if not content or not content.strip():
        raise ValueError("empty answer")
    usage = found.get("usage") or {}
    return Reply(content, int(usage.get("prompt_tokens", 0)), int(usage.get("completion_tokens", 0)), float(usage.get("cost", 0.0)))


@dataclass(frozen=True)
class Http:
    """A chat-completion service. Refusals (4xx but 429) are final; anything else is tried again, waiting longer each time."""

    model: str
    url: str
    key: str
    timeout: float = 180.0
    attempts: int = 5
    wait: float = 2.0

    def complete(self, system: str, user: str, schema: dict) -> Reply:
        asked = {
            "model": self.model,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
            "response_format": {"type": "json_schema", "json_schema": {"name": "verdict", "strict": True, "schema": schema}},
            "temperature": 0,
            "usage": {"include": True},
        }
        request = urllib.request.Request(self.url, json.dumps(asked).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        failed = ""
        for attempt in range(self.attempts):
            if attempt:
                time.sleep(self.wait * 2 ** (attempt - 1))
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return read_reply(answer.read().decode())
            except urllib.error.HTTPError as e:
                failed = f"HTTP {e.code}: {e.read().decode(errors='replace')[:400]}"
                if 400 <= e.code < 500 and e.code != 429:
                    raise Refused(failed) from e
            except (OSError, ValueError) as e:
                failed = str(e)
        raise Refused(f"no answer after {self.attempts} attempts: {failed}")
