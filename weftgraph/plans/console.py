"""What a console asks of a session: requests and replies as JSON."""

from __future__ import annotations

import json
import resource
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import functions as F

from weftgraph.operators import query
from weftgraph.plans.session import Break, Session
from weftgraph.sources.logs import read_logs

#: Requests that a graph provider passes on, by the names that requests use for them.
CRITERIA = {"Highest state": "highest_state", "Lowest state": "lowest_state", "Highest degree": "highest_degree", "Above signal thresh.": "above_score", "Above collect thresh.": "above_score", "Sample": "sample"}


class Console:
    """Answers requests about a session. A reply names its provider; what a request gets wrong is told in an `error` reply, not raised."""

    def __init__(self, session: Session | None, logs: str | None = None):
        self.session, self.logs = session, logs
        self.providers: dict[str, Callable[[dict], dict]] = {
            "configuration": self._configuration, "state": self._state, "resources": self._resources, "graph": self._graph, "log": self._log,
            "controls": self._controls, "breakconditions": self._breaks,
        }

    def handle(self, request: str) -> str:
        try:
            asked = json.loads(request)
            name = asked["provider"]
        except (ValueError, KeyError, TypeError):
            return json.dumps({"provider": "invalid", "error": "a request is a JSON object with a provider"})
        if name not in self.providers:
            return json.dumps({"provider": "invalid", "error": f"no provider {name}"})
        if self.session is None:
            return json.dumps({"provider": "notready"})
        try:
            return json.dumps({"provider": name, **self.providers[name](asked)})
        except (ValueError, KeyError, TypeError, RuntimeError) as e:
            return json.dumps({"provider": "error", "of": name, "error": str(e)})

    def _configuration(self, asked: dict) -> dict:
        config = asdict(self.session.computation.config)
        return {"execution": {k: v for k, v in config.items() if isinstance(v, str | int | float | bool | None)}}

    def _state(self, asked: dict) -> dict:
        s = self.session
        return {"state": s.phase, "steps": s.computation.steps, "reason": s.reason.value, "active": s.computation.active}

    def _resources(self, asked: dict) -> dict:
        c = self.session.computation
        counters = {"vertices": c.size, "edges": c.n_edges, "signalled": sum(m.signalled for m in c.metrics), "collected": sum(m.collected for m in c.metrics), "steps": c.steps}
        tracker = c.spark.sparkContext.statusTracker()
        return {"workers": counters | {"partitions": c.partitions, "driver_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024, "active_stages": len(tracker.getActiveStageIds())}}

    def _graph(self, asked: dict) -> dict:
        c = self.session.computation
        request, kind, n = {}, asked.get("query"), int(asked.get("targetCount", 5))
        if kind == "top":
            criterion = asked.get("topCriterium")
            if criterion not in CRITERIA:
                raise ValueError(f"no such criterion: {criterion}")
            request = {"kind": CRITERIA[criterion], "n": n}
            if request["kind"] == "above_score":
                score = c.program.score_signal if "signal" in criterion else c.program.score_collect
                request |= {"score": score(), "threshold": float(asked.get("threshold", c.config.signal_threshold))}
        elif kind == "substring":
            request = {"kind": "substring", "part": str(asked["queryString"]), "n": n}
        elif kind not in (None, "vertexIds"):
            raise ValueError(f"no such query: {kind}")
        found = query.fetch_graph(c.graph, [str(x) for x in asked.get("vertexIds", [])], radius=int(asked.get("vicinityRadius", 0)), incoming=bool(asked.get("vicinityIncoming", False)), score_signal=c.program.score_signal, score_collect=c.program.score_collect, **request)
        rows = [json.loads(r) for r in found.orderBy("id").toJSON().collect()]  # as many as a request may ask for, and their vicinity
        edges = {str(r["id"]): [str(t) for t in r.pop("targets", [])] for r in rows}
        return {"vertices": {str(r["id"]): r for r in rows}, "edges": {k: v for k, v in edges.items() if v}}

    def _log(self, asked: dict) -> dict:
        if not self.logs:
            return {"messages": []}
        rows = read_logs(self.session.computation.spark, self.logs, asked.get("level"), float(asked.get("since", 0)))
        return {"messages": [json.loads(r) for r in rows.select(F.struct("*").alias("r")).select("r.*").toJSON().collect()]}

    def _controls(self, asked: dict) -> dict:
        s, control = self.session, asked.get("control")
        actions = {"step": s.step, "collect": s.collect, "continue": s.start, "pause": s.pause, "reset": s.reset, "terminate": s.terminate}
        if control not in actions:
            raise ValueError(f"no such control: {control}")
        actions[control]()
        return {"done": control} | self._state(asked)

    def _breaks(self, asked: dict) -> dict:
        s, action, added = self.session, asked.get("action"), None
        if action == "add":
            added = s.add_break(Break(asked["name"], asked["vertexId"], asked.get("expectedState")))
        elif action == "remove":
            s.remove_break(int(asked["id"]))
        elif action is not None:
            raise ValueError(f"no such action: {action}")
        return {"added": added, "active": {str(n): {"name": b.kind, "vertexId": b.vertex_id} for n, b in s.breaks.items()}}
