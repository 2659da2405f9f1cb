"""Named filter documents in a JSON file."""

from __future__ import annotations

import json
from pathlib import Path

from . import rules


def unique_name(name: str, taken: list[str]) -> str:
    """The name, or with " (2)", " (3)" and so on; case doesn't tell names apart."""
    have = {t.lower() for t in taken}
    base = name.strip() or "Filter"
    out, n = base, 2
    while out.lower() in have:
        out, n = f"{base} ({n})", n + 1
    return out


class Presets:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        raw = json.loads(self.path.read_text()) if self.path.exists() else {}
        self.items = [{"id": p.get("id") or rules.new_id("preset"), "name": unique_name(str(p.get("name") or ""), []), "filters": rules.normalize(p.get("filters"))} for p in raw.get("items", [])] or [self._new("Filter", None)]
        self.active = raw.get("active") if any(p["id"] == raw.get("active") for p in self.items) else self.items[0]["id"]

    @staticmethod
    def _new(name: str, filters: dict | None) -> dict:
        return {"id": rules.new_id("preset"), "name": name, "filters": rules.normalize(filters)}

    def save(self) -> None:
        self.path.write_text(json.dumps({"active": self.active, "items": self.items}, indent=1))

    def get(self, preset_id: str | None = None) -> dict:
        return next(p for p in self.items if p["id"] == (preset_id or self.active))

    def commit(self, filters: dict) -> None:
        self.get()["filters"] = rules.normalize(filters)

    def select(self, preset_id: str) -> None:
        self.active = self.get(preset_id)["id"]

    def create(self, name: str, filters: dict | None = None) -> dict:
        p = self._new(unique_name(name, [x["name"] for x in self.items]), filters)
        self.items.append(p)
        self.active = p["id"]
        return p

    def rename(self, preset_id: str, name: str) -> None:
        self.get(preset_id)["name"] = unique_name(name, [x["name"] for x in self.items if x["id"] != preset_id])

    def duplicate(self, preset_id: str) -> dict:
        return self.create(self.get(preset_id)["name"], rules.clone(self.get(preset_id)["filters"]))

    def remove(self, preset_id: str) -> bool:
        """False for the last one, which stays."""
        if len(self.items) == 1:
            return False
        self.items = [p for p in self.items if p["id"] != preset_id]
        if self.active == preset_id:
            self.active = self.items[0]["id"]
        return True
