"""A chat backend over HTTP for any server with the common chat-completions interface."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from ..functions.text import classify
from ..operators.calls import ModelError, Reply
from ..plans.config import Role

@dataclass(frozen=True)
class HttpModels:
    """Chat calls by role. A role's own endpoint goes before the common one; keys are read from the environment where the call runs."""

    endpoint: str
    roles: dict[str, Role]
    key_variable: str = ""
    extra: dict[str, dict] = field(default_factory=dict)

    def request(self, role: str, system: str, user: str) -> dict:
        """The body of a call: thinking goes with its own switch, an effort with another."""
        r = self.roles[role]
        body = {"model": r.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "max_tokens": r.max_tokens, "temperature": r.temperature}
        if r.thinking:
            body["chat_template_kwargs"] = {"enable_thinking": True}
        for name in ("top_p", "top_k", "presence_penalty"):
            if getattr(r, name) is not None:
                body[name] = getattr(r, name)
        if r.reasoning_effort is not None:
            body["reasoning_effort"] = r.reasoning_effort
        return body | self.extra.get(role, {})

    def reply(self, role: str, system: str, user: str, attempt: int) -> Reply:
        headers = {"Content-Type": "application/json"}
        if key := self.roles[role].key_variable or self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[key]}"
        request = Request(self.roles[role].endpoint or self.endpoint, json.dumps(self.request(role, system, user)).encode(), headers)
        try:
            with urlopen(request, timeout=self.roles[role].timeout_s) as response:
                got = json.load(response)
        except HTTPError as e:
            said = e.read().decode(errors="replace")
            raise ModelError(classify(e.code, said), f"{e.code}: {said[:500]}") from e
        except (URLError, TimeoutError, OSError, ValueError) as e:
            raise ModelError(classify(None, str(e)), str(e)) from e
        try:
            choice, used = got["choices"][0], got.get("usage") or {}
            text = choice["message"].get("content") or ""
        except (KeyError, IndexError, TypeError, AttributeError) as e:
            raise ModelError(classify(None, str(e)), f"an unreadable reply: {str(got)[:200]}") from e
        more = lambda part, name: (used.get(part) or {}).get(name)
        return Reply(
            text, choice.get("finish_reason") == "length", got.get("model", self.roles[role].model), used.get("prompt_tokens"), used.get("completion_tokens"),
            more("completion_tokens_details", "reasoning_tokens"), more("prompt_tokens_details", "cached_tokens"),
        )
