"""Languages by file extension, and the engines that turn a file's text into facts."""

from __future__ import annotations

from .go import snapshot as _go
from .java import snapshot as _java
from .javascript import javascript as _javascript
from .javascript import tsx as _tsx
from .javascript import typescript as _typescript
from .python import snapshot as _python

#: Extensions of each language.
EXTENSIONS = {"python": ("py", "pyw", "pyi"), "javascript": ("js", "mjs", "cjs", "jsx"), "typescript": ("ts",), "tsx": ("tsx",), "java": ("java",), "go": ("go",)}
BY_EXTENSION = {e: language for language, all_of in EXTENSIONS.items() for e in all_of}
#: Engines: text to facts.
ENGINES = {"go": _go, "java": _java, "javascript": _javascript, "python": _python, "tsx": _tsx, "typescript": _typescript}


def detect(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return BY_EXTENSION.get(name.rpartition(".")[2]) if "." in name else None
