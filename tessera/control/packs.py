"""Logic packs (rules and models in one JSON file) and a local hub of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from tessera.errors import EngineError


@dataclass
class Pack:
    name: str
    version: str = "1.0.0"
    description: str = ""
    rules: list[dict] = field(default_factory=list)  # name, source
    models: list[dict] = field(default_factory=list)  # native: function_id, weights, bias; a file: name, artifact_path, num_features
    tags: list[str] = field(default_factory=list)
    folder: str = field(default="", compare=False)  # where it was read: paths of model files may be relative to it

    def rule(self, name: str, source: str) -> Pack:
        self.rules.append({"name": name, "source": source})
        return self

    def model(self, **entry) -> Pack:
        self.models.append(entry)
        return self

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({k: v for k, v in asdict(self).items() if k != "folder"}, indent=1))

    @classmethod
    def load(cls, path: str) -> Pack:
        data = json.loads(Path(path).read_text())
        rules = [{"name": r["name"], "source": r.get("source") or r.get("rule") or r.get("body") or r.get("datalog")} for r in data.get("rules", [])]
        return cls(data["name"], data.get("version", "1.0.0"), data.get("description", ""), rules, data.get("models", []), data.get("tags", []), str(Path(path).parent))


#: Packs every hub knows from the start: rules over the star schema.
SEED = (
    Pack("discount-review", description="order lines sold far below their price", tags=["sales", "pricing"]).rule("deep_discount", "deep_discount(L) :- lineitem(L), L.l_discount > 0.08, L.l_quantity > 30."),
    Pack("supplier-terms", description="suppliers that owe money, with their nation", tags=["purchasing"]).rule("owing", "owing(S) :- supplier(S), nation(N), S.s_nationkey = N.n_nationkey, S.s_acctbal < 0."),
    Pack("event-quality", description="events of little value", tags=["stream", "monitoring"]).rule("weak", "weak(E) :- events(E), E.value < 2."),
)


class Hub:
    """An index of packs in a folder; what it does not know cannot be installed."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        for pack in SEED:
            if not (self.folder / f"{pack.name}.json").exists():
                self.publish(pack)
        self.installed: dict[str, Pack] = {}

    def packs(self) -> list[Pack]:
        return [Pack.load(str(p)) for p in sorted(self.folder.glob("*.json"))]

    def search(self, word: str) -> list[Pack]:
        """Packs whose name, description or tags have the word, whatever the case."""
        w = word.lower()
        return [p for p in self.packs() if w in p.name.lower() or w in p.description.lower() or any(w in t.lower() for t in p.tags)]

    def publish(self, pack: Pack) -> str:
        """Add or replace a pack; returns its checksum, which every install compares with the file."""
        path = self.folder / f"{pack.name}.json"
        pack.save(str(path))
        path.with_suffix(".sha256").write_text(digest := hashlib.sha256(path.read_bytes()).hexdigest())
        return digest

    def install(self, reference: str) -> Pack:
        """A pack by name, or name@version, which must be the version that is there."""
        name, _, version = reference.rpartition("/")[2].partition("@")
        path = self.folder / f"{name}.json"
        if not path.exists():
            raise EngineError(f"the hub has no pack {name!r}")
        told = path.with_suffix(".sha256")
        if told.exists() and told.read_text().strip() != hashlib.sha256(path.read_bytes()).hexdigest():
            raise EngineError(f"pack {name!r} is not what was published: its checksum differs")
        pack = Pack.load(str(path))
        if version and pack.version != version:
            raise EngineError(f"the hub has {name!r} in version {pack.version}, not {version}")
        self.installed[name] = pack
        return pack
