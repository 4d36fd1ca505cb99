"""Names for components, so that a configuration can build them."""

from __future__ import annotations

import importlib.util
import inspect
from collections.abc import Callable


class Registry:
    def __init__(self):
        self._held: dict[str, dict[str, Callable]] = {}

    def register(self, namespace: str, name: str, factory: Callable | None = None):
        def put(f: Callable) -> Callable:
            if name in self._held.setdefault(namespace, {}):
                raise ValueError(f"{namespace} {name!r} is registered already")
            self._held[namespace][name] = f
            return f

        return put if factory is None else put(factory)

    def options(self, namespace: str | None = None):
        return sorted(self._held) if namespace is None else sorted(self._held.get(namespace, {}))

    def need(self, package: str, component: str) -> None:
        """Fails where a component is built, not where it is registered, if its optional package is missing."""
        if importlib.util.find_spec(package) is None:
            raise ImportError(f"{component} needs the package {package}, which isn't installed; other components work without it")

    def build(self, namespace: str, spec: dict | str, **injected):
        """The component a spec names; injected values are passed on where the factory has such a parameter and the spec doesn't set it."""
        spec = {"type": spec} if isinstance(spec, str) else dict(spec)
        name = spec.pop("type", None)
        if name not in self._held.get(namespace, {}):
            raise KeyError(f"no {namespace} {name!r}; there are: {', '.join(self.options(namespace))}")
        factory = self._held[namespace][name]
        takes = inspect.signature(factory).parameters
        given = {k: v for k, v in injected.items() if k in takes} | spec
        try:
            return factory(**given)
        except TypeError as e:
            raise TypeError(f"{namespace} {name!r} can't be built with {sorted(given)}: {e}") from e


registry = Registry()
