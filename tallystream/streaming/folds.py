"""State machines as folds of ordered commands.

A fold is built from its configuration, takes one command (a dict with ``op``,
``now_ms`` and what the operation needs) after another, and answers each with a
dict: ``ok`` and its results, or ``error``.  A refused command changes nothing
but what its maintenance did.  State is plain data, so ``dump`` and ``load`` are
JSON; the same class serves batches and streams.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

from tallystream.functions.retry import RetryPolicy


class Refused(Exception):
    """A command that the state excludes; its text is the answer's ``error``."""


class Fold:
    """Base of all folds: dispatch by ``op``, and state as JSON."""

    config: object = None

    def apply(self, command: dict) -> dict:
        """The answer to a command."""
        handler = getattr(self, f"do_{command.get('op')}", None)
        if handler is None:
            return {"ok": False, "error": "unknown_operation"}
        try:
            return {"ok": True, **(handler(command) or {})}
        except Refused as reason:
            return {"ok": False, "error": str(reason)}

    def dump(self) -> str:
        """The state as JSON."""
        return json.dumps({k: v for k, v in vars(self).items() if k != "config"}, sort_keys=True, separators=(",", ":"))

    def load(self, state: str) -> Fold:
        """Takes over a dumped state."""
        vars(self).update(json.loads(state))
        return self


def _need(condition: bool, error: str) -> None:
    if not condition:
        raise Refused(error)


@dataclass(frozen=True)
class Dispatch:
    """A token bucket and circuit breaker for acquisitions."""

    per_second: int = 100
    burst: int = 100
    max_in_flight: int = 1_000
    failure_threshold: int = 5
    open_ms: int = 1_000


@dataclass(frozen=True)
class QueueConfig:
    """A queue's limits; times in milliseconds."""

    visibility_ms: int = 30_000
    max_messages: int = 100_000
    max_active_bytes: int | None = None
    dedupe_window_ms: int | None = None
    overflow: str = "reject_new"
    aging_ms: int | None = None
    idle_ms: int | None = None
    retry: RetryPolicy = field(default_factory=RetryPolicy)
    dispatch: Dispatch | None = None


class QueueFold(Fold):
    """A work queue: leases, retries, dead letters, sessions, deferral, flow control.

    Operations: enqueue, acquire, acquire_session, ack, nack, release, reject,
    extend, defer, receive_deferred, renew_session, release_session, redrive,
    maintain.  Due messages are found by a heap of deadlines and the next ones by
    a heap of ready messages, whose stale entries are skipped.
    """

    def __init__(self, config: QueueConfig | None = None):
        self.config = config or QueueConfig()
        self.messages: dict[str, dict] = {}
        self.position, self.generation, self.sequence = 0, 0, 0
        self.ready: list[list] = []
        self.due: list[list] = []
        self.dedupe: dict[str, list] = {}
        self.letters: list[str] = []
        self.leases: dict[str, str] = {}
        self.deferred: dict[str, str] = {}
        self.locks: dict[str, dict] = {}
        self.lock_generation = 0
        self.terms: dict[str, int] = {}
        self.active, self.active_bytes = 0, 0
        self.circuit = {"state": "closed", "failures": 0, "open_until": None, "probe": None, "milli": None, "refilled": None}
        self.last_activity, self.expired = None, False

    # Each message has: state, priority, enqueued, attempt, position, order, bytes, ttl, session,
    # correlation, eligible, deadline, token, consumer, reason, dead_at.

    def _move(self, m: dict, state: str, **more) -> None:
        if m["token"]:
            self.leases.pop(m["token"], None)
        m.update(state=state, token=None, consumer=None, deadline=None, eligible=None)
        m.update(more)
        if state in ("acknowledged", "expired", "dead_lettered"):
            self.active -= 1
            self.active_bytes -= m["bytes"]
            self.deferred.pop(m["id"], None)
        elif state == "ready":
            self._push_ready(m)
        elif state == "scheduled":
            heapq.heappush(self.due, [m["eligible"], m["id"]])

    def _push_ready(self, m: dict) -> None:
        if m["session"] is None:
            # Among waiting messages the order by aged priority never changes but at interval borders,
            # so with aging the heap is only a set and candidates are sorted when they are asked for.
            heapq.heappush(self.ready, [-m["priority"], m["position"], m["id"]])

    def _next(self) -> int:
        self.position += 1
        return self.position

    def _terminal_at(self, m: dict) -> int | None:
        bounds = [m["enqueued"] + x for x in (m["ttl"], self.config.retry.max_age_ms) if x is not None]
        return min(bounds, default=None)

    def _dead(self, m: dict, reason: str, now: int) -> None:
        self._next()
        self._move(m, "dead_lettered", reason=reason, dead_at=now)
        self.letters.append(m["id"])

    def _retry(self, m: dict, delay: int, reason: str | None, now: int) -> None:
        if m["attempt"] >= self.config.retry.max_attempts:
            self._dead(m, reason or "retry_exhausted", now)
            return
        self._next()
        if delay == 0:
            self._move(m, "ready", reason=reason)
        else:
            self._move(m, "scheduled", reason=reason, eligible=now + delay)

    def _maintain(self, now: int) -> None:
        self.dedupe = {k: v for k, v in self.dedupe.items() if v[1] > now} if any(v[1] <= now for v in self.dedupe.values()) else self.dedupe
        ripe = set()
        while self.due and self.due[0][0] <= now:
            ripe.add(heapq.heappop(self.due)[1])
        for i in sorted(ripe, key=lambda i: self.messages[i]["order"]):
            m = self.messages[i]
            if m["state"] in ("acknowledged", "expired", "dead_lettered"):
                continue
            end = self._terminal_at(m)
            if end is not None and end <= now:
                self._next()
                self._move(m, "expired")
            elif m["state"] == "scheduled" and m["eligible"] <= now:
                self._move(m, "ready")
            elif m["state"] == "leased" and m["deadline"] <= now:
                self._failure(m, now)
                self._retry(m, self.config.retry.message_delay(i, m["attempt"]), "visibility_timeout", now)
        self.locks = {k: v for k, v in self.locks.items() if v["deadline"] > now}
        idle = self.config.idle_ms
        if idle is not None and self.last_activity is not None and not self.active and not self.locks and now >= self.last_activity + idle:
            self.expired = True

    def _touch(self, now: int) -> None:
        self.last_activity = now if self.last_activity is None else max(self.last_activity, now)

    def do_maintain(self, c: dict) -> dict:
        self._maintain(c["now_ms"])
        return {"active": self.active, "expired": self.expired}

    def do_enqueue(self, c: dict) -> dict:
        now, i = c["now_ms"], c.get("id")
        _need(not self.expired, "queue_expired")
        _need(bool(i and i.strip()) and 0 <= (c.get("priority") or 0) <= 9, "invalid_argument")
        self._maintain(now)
        window, key = self.config.dedupe_window_ms, c.get("dedupe_id")
        if window is not None and key in self.dedupe:
            return {"id": self.dedupe[key][0], "duplicate": True}
        size = c.get("bytes") or 0
        self._make_room(size, now)
        _need(i not in self.messages, "already_exists")
        at = c.get("deliver_at_ms")
        self.sequence += 1
        m = {
            "id": i, "state": "ready", "priority": c.get("priority") or 0, "enqueued": now, "attempt": 0, "position": self._next(), "order": self.sequence, "bytes": size, "ttl": c.get("ttl_ms"),
            "session": c.get("session_id"), "correlation": c.get("correlation_id"), "eligible": None, "deadline": None, "token": None, "consumer": None, "reason": None, "dead_at": None,
        }
        self.messages[i] = m
        self.active += 1
        self.active_bytes += size
        if at is not None and at > now:
            m.update(state="scheduled", eligible=at)
            heapq.heappush(self.due, [at, i])
        else:
            self._push_ready(m)
        if (end := self._terminal_at(m)) is not None:
            heapq.heappush(self.due, [end, i])
        if window is not None and key is not None:
            self.dedupe[key] = [i, now + window]
        self._touch(now)
        return {"id": i, "duplicate": False, "position": m["position"]}

    def _make_room(self, size: int, now: int) -> None:
        limit = self.config.max_active_bytes
        while self.active >= self.config.max_messages or (limit is not None and self.active_bytes + size > limit):
            _need(self.config.overflow != "reject_new", "capacity")
            pool = [m for m in self.messages.values() if m["state"] in ("ready", "scheduled")]
            _need(bool(pool), "capacity")
            oldest = min(pool, key=lambda m: (m["position"], m["id"]))
            if self.config.overflow == "drop_oldest":
                self._next()
                self._move(oldest, "expired")
            else:
                self._dead(oldest, "overflow", now)

    def _ready_ids(self, limit: int, now: int) -> list[str]:
        ok = lambda e: (m := self.messages[e[2]])["state"] == "ready" and m["position"] == e[1] and e[2] not in self.deferred
        if self.config.aging_ms:
            pool = {e[2]: e for e in self.ready if ok(e)}
            aged = lambda m: min(m["priority"] + max(now - m["enqueued"], 0) // self.config.aging_ms, 255)
            ranked = sorted(pool, key=lambda i: (-aged(self.messages[i]), self.messages[i]["position"], i))
            self.ready = [pool[i] for i in pool]
            heapq.heapify(self.ready)
            return ranked[:limit]
        out: list[str] = []
        taken = []
        while self.ready and len(out) < limit:
            entry = heapq.heappop(self.ready)
            if ok(entry) and entry[2] not in out:
                out.append(entry[2])
                taken.append(entry)
            elif entry[2] in self.deferred:
                continue
        for entry in taken:
            heapq.heappush(self.ready, entry)
        return out

    def _lease(self, ids: list[str], c: dict) -> list[dict]:
        now, out = c["now_ms"], []
        for i in ids:
            m = self.messages[i]
            self.generation += 1
            position = self._next()
            deadline = now + (c.get("visibility_ms") or self.config.visibility_ms)
            if (end := self._terminal_at(m)) is not None:
                deadline = min(deadline, end)
            token = f"{i}.{self.generation}.{position}"
            m.update(state="leased", attempt=m["attempt"] + 1, token=token, consumer=c["consumer"], deadline=deadline, eligible=None)
            self.leases[token] = i
            heapq.heappush(self.due, [deadline, i])
            out.append({"id": i, "token": token, "attempt": m["attempt"], "deadline_ms": deadline})
        if out:
            self._touch(now)
        return out

    def _accept(self, c: dict) -> None:
        _need(bool(c.get("consumer")), "invalid_argument")
        _need((c.get("visibility_ms") or 1) > 0, "invalid_argument")
        term = c.get("consumer_term")
        if term is not None:
            _need(term >= self.terms.get(c["consumer"], 0), "fenced")
            self.terms[c["consumer"]] = term

    def do_acquire(self, c: dict) -> dict:
        self._accept(c)
        now = c["now_ms"]
        self._maintain(now)
        limit = c.get("max") or 1
        if (credit := c.get("credit")) is not None:
            limit = min(limit, max(credit - sum(self.messages[i]["consumer"] == c["consumer"] for i in self.leases.values()), 0))
        limit = self._allowance(limit, now)
        leased = self._lease(self._ready_ids(limit, now), c)
        self._spend(leased)
        return {"leased": leased}

    def do_acquire_session(self, c: dict) -> dict:
        self._accept(c)
        now, session = c["now_ms"], c.get("session_id")
        _need(bool(session), "invalid_argument")
        self._maintain(now)
        lock, token = self.locks.get(session), c.get("lock_token")
        if lock:
            _need(token == lock["token"] and lock["consumer"] == c["consumer"], "conflict")
        else:
            _need(token is None, "fenced")
            self.lock_generation += 1
            deadline = now + (c.get("visibility_ms") or self.config.visibility_ms)
            lock = self.locks[session] = {"consumer": c["consumer"], "generation": self.lock_generation, "token": f"{session}.{self.lock_generation}", "deadline": deadline}
        pool = sorted((m["position"], m["id"]) for m in self.messages.values() if m["session"] == session and m["state"] == "ready" and m["id"] not in self.deferred)
        leased = self._lease([i for _, i in pool[: self._allowance(c.get("max") or 1, now)]], c)
        self._spend(leased)
        return {"leased": leased, "lock_token": lock["token"], "lock_deadline_ms": lock["deadline"]}

    def _lock(self, c: dict) -> dict:
        self._maintain(c["now_ms"])
        lock = self.locks.get(c.get("session_id"))
        _need(lock is not None and lock["token"] == c.get("lock_token") and lock["consumer"] == c.get("consumer"), "fenced")
        return lock

    def do_renew_session(self, c: dict) -> dict:
        lock = self._lock(c)
        deadline = c["now_ms"] + (c.get("visibility_ms") or self.config.visibility_ms)
        _need(deadline > lock["deadline"], "conflict")
        self.lock_generation += 1
        lock.update(deadline=deadline, generation=self.lock_generation, token=f"{c['session_id']}.{self.lock_generation}")
        return {"lock_token": lock["token"], "lock_deadline_ms": deadline}

    def do_release_session(self, c: dict) -> dict:
        self._lock(c)
        del self.locks[c["session_id"]]
        return {}

    def _held(self, c: dict) -> dict:
        self._maintain(c["now_ms"])
        i = self.leases.get(c.get("token"))
        _need(i is not None, "fenced")
        self._touch(c["now_ms"])
        return self.messages[i]

    def do_ack(self, c: dict) -> dict:
        m = self._held(c)
        self._success(m)
        self._move(m, "acknowledged")
        return {"id": m["id"], "position": self._next()}

    def do_nack(self, c: dict) -> dict:
        _need(bool((c.get("reason") or "").strip()), "invalid_argument")
        m = self._held(c)
        self._failure(m, c["now_ms"])
        self._retry(m, self.config.retry.message_delay(m["id"], m["attempt"]), c["reason"], c["now_ms"])
        return {"id": m["id"], "state": m["state"], "eligible_at_ms": m["eligible"]}

    def do_release(self, c: dict) -> dict:
        m = self._held(c)
        self._retry(m, c.get("delay_ms") or 0, c.get("reason"), c["now_ms"])
        return {"id": m["id"], "state": m["state"], "eligible_at_ms": m["eligible"]}

    def do_reject(self, c: dict) -> dict:
        m = self._held(c)
        self._failure(m, c["now_ms"])
        self._dead(m, c.get("reason") or "rejected", c["now_ms"])
        return {"id": m["id"], "state": m["state"]}

    def do_extend(self, c: dict) -> dict:
        _need((c.get("extension_ms") or 0) > 0, "invalid_argument")
        m = self._held(c)
        deadline = c["now_ms"] + c["extension_ms"]
        if (end := self._terminal_at(m)) is not None:
            deadline = min(deadline, end)
        m["deadline"] = max(m["deadline"], deadline)
        heapq.heappush(self.due, [m["deadline"], m["id"]])
        return {"id": m["id"], "deadline_ms": m["deadline"]}

    def do_defer(self, c: dict) -> dict:
        m = self._held(c)
        self._next()
        self.deferred[m["id"]] = c.get("consumer") or ""
        self._move(m, "ready")
        return {"id": m["id"]}

    def do_receive_deferred(self, c: dict) -> dict:
        self._accept(c)
        self._maintain(c["now_ms"])
        i = c.get("id")
        _need(i in self.deferred and self.messages[i]["state"] == "ready", "not_found")
        del self.deferred[i]
        return {"leased": self._lease([i], c)}

    def do_redrive(self, c: dict) -> dict:
        i = c.get("id")
        _need(i in self.letters, "not_found")
        self.letters.remove(i)
        m = self.messages[i]
        self.sequence += 1
        m.update(attempt=0, position=self._next(), order=self.sequence, dead_at=None)
        self.active += 1
        self.active_bytes += m["bytes"]
        self._move(m, "ready", reason=None)
        self._touch(c["now_ms"])
        return {"id": i, "position": m["position"]}

    def observation(self) -> dict:
        """Counts and flow state."""
        states = ("ready", "scheduled", "leased", "acknowledged", "dead_lettered", "expired")
        counts = {s: sum(m["state"] == s for m in self.messages.values()) for s in states}
        return {**counts, "active": self.active, "active_bytes": self.active_bytes, "deferred": len(self.deferred), "locks": len(self.locks), "circuit": self.circuit["state"], "queue_expired": self.expired}

    # Flow control: tokens are kept in thousandths.

    def _allowance(self, wanted: int, now: int) -> int:
        policy, s = self.config.dispatch, self.circuit
        if policy is None:
            return wanted
        if s["state"] != "half_open" or s["probe"] not in self.leases:
            s["probe"] = None
        if s["state"] == "open":
            if now < s["open_until"]:
                return 0
            s.update(state="half_open", milli=max(s["milli"] or 0, 1_000), probe=None)
        full = policy.burst * 1_000
        if s["refilled"] is None:
            s.update(milli=full, refilled=now)
        else:
            s.update(milli=min(s["milli"] + max(now - s["refilled"], 0) * policy.per_second, full), refilled=max(now, s["refilled"]))
        room = max(policy.max_in_flight - len(self.leases), 0)
        probes = (0 if s["probe"] else 1) if s["state"] == "half_open" else wanted
        return min(wanted, s["milli"] // 1_000, room, probes)

    def _spend(self, leased: list[dict]) -> None:
        if self.config.dispatch is not None and leased:
            self.circuit["milli"] -= 1_000 * len(leased)
            if self.circuit["state"] == "half_open":
                self.circuit["probe"] = leased[0]["token"]

    def _success(self, m: dict) -> None:
        s = self.circuit
        if self.config.dispatch is not None and (s["state"] != "half_open" or s["probe"] == m["token"]):
            s.update(state="closed", failures=0, open_until=None, probe=None)

    def _failure(self, m: dict, now: int) -> None:
        s, policy = self.circuit, self.config.dispatch
        if policy is None:
            return
        s["failures"] += 1
        if s["failures"] >= policy.failure_threshold or (s["state"] == "half_open" and s["probe"] == m["token"]):
            s.update(state="open", open_until=now + policy.open_ms, probe=None, failures=0)


class DeliveryFold(Fold):
    """A delivery ledger: publish, acquire, ack, fail, reject, maintain.

    An acquisition stops at the first delivery whose subscription's window is
    full or whose target needs an acquisition of its own.
    """

    STATES = ("pending", "in_flight", "acknowledged", "dead_lettered")

    def __init__(self, retry: RetryPolicy | None = None, max_in_flight: int = 16, timeout_ms: int = 30_000, capacity: int = 1_000_000):
        self.config = (retry or RetryPolicy(), max_in_flight, timeout_ms, capacity)
        self.records: dict[str, dict] = {}
        self.pending: dict[str, list] = {}
        self.in_flight: dict[str, int] = {}
        self.leases: list[list] = []
        self.terms: dict[str, int] = {}
        self.generation = 0

    def counts(self) -> dict:
        """Deliveries in each state."""
        return {s: sum(r["state"] == s for r in self.records.values()) for s in self.STATES}

    def do_publish(self, c: dict) -> dict:
        retry, _, _, capacity = self.config
        names = sorted(c["subscriptions"])
        _need(len(self.records) + len(names) <= capacity, "capacity")
        ids = [f"delivery.v1.{c['position']}.{s}" for s in names]
        _need(not any(i in self.records for i in ids), "duplicate")
        for i, s in zip(ids, names, strict=True):
            target = c["subscriptions"][s] if isinstance(c["subscriptions"], dict) else "pull"
            end = c["now_ms"] + retry.max_age_ms if retry.max_age_ms is not None else None
            self.records[i] = {"id": i, "position": c["position"], "subscription": s, "target": target, "state": "pending", "eligible": c["now_ms"], "expires": end, "attempt": 0, "dispatcher": None, "token": None, "deadline": None, "reason": None}
            heapq.heappush(self.pending.setdefault(s, []), [c["position"], i])
        return {"deliveries": ids}

    def do_acquire(self, c: dict) -> dict:
        _, window, timeout, _ = self.config
        now, s, limit = c["now_ms"], c["subscription"], c.get("max") or 1
        _need(1 <= limit <= 100, "invalid_argument")
        self._term(c)
        waiting, later, out = self.pending.get(s, []), [], []
        while waiting and len(out) < limit:
            entry = heapq.heappop(waiting)
            r = self.records[entry[1]]
            if r["state"] != "pending":
                continue
            if r["eligible"] > now:
                later.append(entry)
                continue
            if r["target"].split(":")[0] in ("queue", "stream") or self.in_flight.get(s, 0) >= window:
                later.append(entry)
                break
            self.generation += 1
            self.in_flight[s] = self.in_flight.get(s, 0) + 1
            r.update(state="in_flight", attempt=r["attempt"] + 1, dispatcher=c["dispatcher"], token=f"{r['id']}.{self.generation}", deadline=now + timeout)
            heapq.heappush(self.leases, [r["deadline"], r["id"], r["token"]])
            out.append({"id": r["id"], "token": r["token"], "attempt": r["attempt"]})
        for entry in later:
            heapq.heappush(waiting, entry)
        return {"leased": out}

    def _term(self, c: dict) -> None:
        term = c.get("dispatcher_term") or 1
        _need(term >= self.terms.get(c["dispatcher"], 0), "fenced")
        self.terms[c["dispatcher"]] = term

    def _held(self, c: dict) -> dict:
        r = self.records.get(c.get("id"))
        _need(r is not None, "not_found")
        self._term(c)
        _need(r["state"] == "in_flight" and r["dispatcher"] == c["dispatcher"] and r["token"] == c.get("token"), "fenced")
        return r

    def _end(self, r: dict, state: str, reason: str | None = None) -> None:
        self.in_flight[r["subscription"]] -= 1
        r.update(state=state, token=None, dispatcher=None, deadline=None, reason=reason)

    def do_ack(self, c: dict) -> dict:
        r = self._held(c)
        self._end(r, "acknowledged")
        return {"id": r["id"]}

    def do_reject(self, c: dict) -> dict:
        _need(bool((c.get("reason") or "").strip()), "invalid_argument")
        r = self._held(c)
        self._end(r, "dead_lettered", c["reason"])
        return {"id": r["id"], "state": r["state"]}

    def do_fail(self, c: dict) -> dict:
        _need(bool((c.get("reason") or "").strip()), "invalid_argument")
        r = self._held(c)
        self._settle(r, c["reason"], c["now_ms"])
        return {"id": r["id"], "state": r["state"], "retry_at_ms": r["eligible"] if r["state"] == "pending" else None}

    def _settle(self, r: dict, reason: str, now: int) -> None:
        retry = self.config[0]
        at = now + retry.delivery_delay(r["id"], r["attempt"])
        over = r["expires"] is not None and (r["expires"] <= now or at >= r["expires"])
        if r["attempt"] >= retry.max_attempts or over:
            self._end(r, "dead_lettered", reason)
        else:
            self._end(r, "pending", reason)
            r["eligible"] = at
            heapq.heappush(self.pending[r["subscription"]], [r["position"], r["id"]])

    def do_maintain(self, c: dict) -> dict:
        limit, done = c.get("max") or 100, {"pending": 0, "dead_lettered": 0}
        _need(1 <= limit <= 100, "invalid_argument")
        while self.leases and self.leases[0][0] <= c["now_ms"] and sum(done.values()) < limit:
            _, i, token = heapq.heappop(self.leases)
            r = self.records[i]
            if r["state"] == "in_flight" and r["token"] == token:
                self._settle(r, "delivery_lease_timeout", c["now_ms"])
                done[r["state"]] += 1
        return {"retried": done["pending"], "dead_lettered": done["dead_lettered"]}


class SessionFold(Fold):
    """A consumer group's members: join, heartbeat, leave, maintain; time never goes back."""

    MAX_MEMBERS = 1_024

    def __init__(self, shards: int = 16):
        self.config = shards
        self.members: dict[str, list] = {}
        self.generation, self.watermark = 0, 0

    def apply(self, command: dict) -> dict:
        self.watermark = max(self.watermark, command["now_ms"])
        gone = sorted(m for m, (_, deadline) in self.members.items() if deadline <= self.watermark)
        for m in gone:
            del self.members[m]
        self._changed = bool(gone)
        answer = super().apply(command)
        if self._changed:
            self.generation = max(self.generation + 1, 1)
        del self._changed
        return {**answer, "expired": gone, "generation": self.generation}

    def do_join(self, c: dict) -> dict:
        member, timeout = c["member"], c["timeout_ms"]
        _need(1_000 <= timeout <= 300_000, "invalid_argument")
        if member not in self.members:
            _need(len(self.members) < self.MAX_MEMBERS, "member_capacity_reached")
            self._changed = True
        self.members[member] = [timeout, self.watermark + timeout]
        return {}

    def _member(self, c: dict) -> str:
        _need(c["member"] in self.members, "unknown_member")
        _need(c.get("generation") == (max(self.generation + 1, 1) if self._changed else self.generation), "stale_generation")
        return c["member"]

    def do_heartbeat(self, c: dict) -> dict:
        member = self._member(c)
        self.members[member][1] = self.watermark + self.members[member][0]
        return {"deadline_ms": self.members[member][1]}

    def do_leave(self, c: dict) -> dict:
        del self.members[self._member(c)]
        self._changed = True
        return {}

    def do_maintain(self, c: dict) -> dict:
        return {}

    def assignments(self) -> dict[str, list[int]]:
        """Shards of each member: shard s goes to member s modulo their number."""
        names = sorted(self.members)
        return {m: list(range(k, self.config, len(names))) for k, m in enumerate(names)}


class OffsetFold(Fold):
    """A group's offsets: claim, commit and reset, fenced by owner and generation.

    ``bounds`` has each partition's base and end.
    """

    def __init__(self, bounds: dict[str, list[int]] | None = None):
        self.config = bounds or {}
        self.offsets: dict[str, int] = {}
        self.owner, self.generation = None, 0

    def do_claim(self, c: dict) -> dict:
        _need(c["generation"] > self.generation or (c["generation"] == self.generation and c["member"] == self.owner), "stale_generation")
        self.owner, self.generation = c["member"], c["generation"]
        return {}

    def _allowed(self, c: dict) -> tuple[str, int, int, int]:
        if self.owner is not None:
            _need(c.get("member") == self.owner and c.get("generation") == self.generation, "fenced")
        p = str(c["partition"])
        _need(p in self.config, "unknown_partition")
        return p, c["offset"], *self.config[p]

    def do_commit(self, c: dict) -> dict:
        p, offset, base, end = self._allowed(c)
        _need(self.offsets.get(p, base) <= offset <= end, "invalid_offset")
        self.offsets[p] = offset
        return {"lag": end - offset}

    def do_reset(self, c: dict) -> dict:
        p, offset, base, end = self._allowed(c)
        _need(base <= offset <= end, "invalid_offset")
        self.offsets[p] = offset
        return {"lag": end - offset}


class ProducerFold(Fold):
    """Idempotent appends and transactions of producers to one partition.

    Operations: append (with ``sequence`` and ``digest``), begin, commit, abort.
    An append that repeats one of the last 256 is a duplicate; a higher term
    starts anew and aborts what was pending.
    """

    HISTORY, PRODUCERS, TRANSACTIONS, TX_RECORDS = 256, 4_096, 1_024, 128

    def __init__(self):
        self.producers: dict[str, dict] = {}
        self.transactions: dict[str, dict] = {}
        self.next_offset = 0

    def _producer(self, c: dict) -> dict:
        name, term = c["producer"], c["term"]
        _need(term > 0, "invalid_argument")
        p = self.producers.get(name)
        if p is None:
            _need(len(self.producers) < self.PRODUCERS, "capacity")
        else:
            _need(term >= p["term"], "fenced")
            if term == p["term"]:
                return p
            for t in self.transactions.values():
                if t["producer"] == name and t["status"] == "pending":
                    t["status"] = "aborted"
        self.producers[name] = p = {"term": term, "next": 0, "history": {}}
        return p

    def do_append(self, c: dict) -> dict:
        p, sequence, tx = self._producer(c), c["sequence"], c.get("transaction_id")
        if tx is not None:
            t = self._pending(c) if sequence >= p["next"] else self.transactions.get(tx)
            _need(t is not None, "not_found")
        if sequence < p["next"]:
            old = p["history"].get(str(sequence))
            _need(old is not None, "history_expired")
            _need(old[0] == c["digest"] and old[2] == tx, "conflict")
            return {"disposition": "duplicate", "offsets": old[1]}
        _need(sequence == p["next"], "sequence_gap")
        count = c.get("records") or 1
        if tx is not None:
            _need(t["records"] + count <= self.TX_RECORDS, "capacity")
            t["records"] += count
        offsets = list(range(self.next_offset, self.next_offset + count))
        self.next_offset += count
        p["next"] += 1
        p["history"][str(sequence)] = [c["digest"], offsets, tx]
        if len(p["history"]) > self.HISTORY:
            del p["history"][str(sequence - self.HISTORY)]
        return {"disposition": "new", "offsets": offsets}

    def do_begin(self, c: dict) -> dict:
        self._producer(c)
        t = self.transactions.get(c["transaction_id"])
        if t is not None:
            _need(t["producer"] == c["producer"] and t["term"] == c["term"], "conflict")
            return {"status": t["status"]}
        _need(len(self.transactions) < self.TRANSACTIONS, "capacity")
        self.transactions[c["transaction_id"]] = {"producer": c["producer"], "term": c["term"], "status": "pending", "records": 0}
        return {"status": "pending"}

    def _pending(self, c: dict) -> dict:
        t = self.transactions.get(c["transaction_id"])
        _need(t is not None, "not_found")
        _need(t["producer"] == c["producer"] and t["term"] == c["term"], "fenced")
        _need(t["status"] == "pending", t["status"])
        return t

    def _finish(self, c: dict, status: str) -> dict:
        self._producer(c)
        t = self.transactions.get(c["transaction_id"])
        _need(t is not None, "not_found")
        _need(t["producer"] == c["producer"] and t["term"] == c["term"], "fenced")
        _need(t["status"] in ("pending", status), t["status"])
        replayed, t["status"] = t["status"] == status, status
        return {"status": status, "replayed": replayed}

    def do_commit(self, c: dict) -> dict:
        return self._finish(c, "committed")

    def do_abort(self, c: dict) -> dict:
        return self._finish(c, "aborted")


@dataclass(frozen=True)
class CacheConfig:
    """A shard's limits."""

    max_entries: int = 10_000
    default_ttl_ms: int | None = None
    policy: str = "no_eviction"
    history: int = 1_024


class CacheFold(Fold):
    """A shard of keyed state: transactions of one revision each, with change history.

    The operation ``transact`` takes ``operations`` (set, delete, increment,
    compare_and_set, access, hash_put, hash_remove, list_push, list_pop, set_add,
    set_remove, sorted_set_add, sorted_set_remove, expire) on distinct keys; they
    all apply or none does.  ``sweep`` removes what is expired, ``restore`` goes
    back to a revision.
    """

    EMPTY = {"hash": dict, "list": list, "set": list, "sorted_set": dict, "counter": int}  # noqa: RUF012

    def __init__(self, config: CacheConfig | None = None):
        self.config = config or CacheConfig()
        self.entries: dict[str, dict] = {}
        self.revision, self.sequence = 0, 0
        self.changes: list[dict] = []

    def _live(self, key: str, now: int) -> dict | None:
        e = self.entries.get(key)
        return e if e is not None and (e["expires"] is None or e["expires"] > now) else None

    def do_transact(self, c: dict) -> dict:
        now, ops = c["now_ms"], c["operations"]
        keys = [o["key"] for o in ops]
        _need(1 <= len(ops) <= 128 and len(set(keys)) == len(keys) and all(keys), "invalid_argument")
        expected = c.get("expected_revision")
        _need(expected is None or expected == self.revision, "conflict")
        planned = {o["key"]: self._plan(o, self._live(o["key"], now), now) for o in ops}
        if not any(changed for _, _, changed in planned.values()):
            return {"revision": self.revision, "results": [planned[k][1] for k in keys], "evicted": []}
        after = {k for k in self.entries if self._live(k, now)} - {k for k, (e, _, _) in planned.items() if e is None} | {k for k, (e, _, _) in planned.items() if e is not None}
        victims = self._victims(len(after) - self.config.max_entries, set(keys), now)
        self.revision += 1
        for key in [k for k in self.entries if not self._live(k, now) and k not in planned]:
            self._write(key, None, "expire")
        for key in victims:
            self._write(key, None, "evict")
        for key, (entry, _, changed) in planned.items():
            if changed:
                if entry is not None:
                    entry = {**entry, "version": self.revision, "last": self.revision}
                self._write(key, entry, "set" if entry else "delete")
        self._trim()
        return {"revision": self.revision, "results": [planned[k][1] for k in keys], "evicted": victims}

    def _write(self, key: str, entry: dict | None, kind: str) -> None:
        before = self.entries.pop(key, None)
        if entry is not None:
            self.entries[key] = entry
        self.sequence += 1
        self.changes.append({"sequence": self.sequence, "revision": self.revision, "key": key, "kind": kind, "before": before, "after": entry})

    def _trim(self) -> None:
        if len(self.changes) > self.config.history:
            floor = self.changes[-self.config.history]["revision"]
            cut = floor if self.changes[-self.config.history - 1]["revision"] < floor else floor + 1
            self.changes = [x for x in self.changes if x["revision"] >= cut]

    def _victims(self, required: int, protected: set[str], now: int) -> list[str]:
        if required <= 0:
            return []
        _need(self.config.policy != "no_eviction", "capacity")
        kind = self.config.policy.removeprefix("all_keys_").removeprefix("volatile_")
        pool = [k for k in self.entries if self._live(k, now) and k not in protected and (self.config.policy.startswith("all_keys_") or self.entries[k]["expires"] is not None)]
        _need(len(pool) >= required, "capacity")

        def rank(k: str) -> tuple:
            e = self.entries[k]
            if kind == "random":
                return hashlib.sha256(b"tallystream/eviction-rank/v1\0" + (self.revision + 1).to_bytes(8, "big") + k.encode()).hexdigest(), k
            return {"lru": (e["last"],), "lfu": (e["count"], e["last"]), "ttl": (e["expires"],)}[kind] + (k,)

        return sorted(heapq.nsmallest(required, pool, key=rank))

    def _plan(self, o: dict, entry: dict | None, now: int) -> tuple[dict | None, object, bool]:
        """The entry after an operation, its result, and whether anything changes."""
        kind = o["op"]
        if kind == "delete":
            return None, {"deleted": entry is not None}, entry is not None
        if kind == "access":
            if entry is None:
                return None, None, False
            return {**entry, "count": entry["count"] + 1}, entry["value"], self.config.policy.endswith(("lru", "lfu"))
        if kind == "expire":
            _need(entry is not None, "not_found")
            return {**entry, "expires": self._deadline(o, now)}, None, True
        if kind == "set":
            condition = o.get("condition", "any")
            _need(condition == "any" or (condition == "absent") == (entry is None), "conflict")
            if (version := o.get("expected_version")) is not None:
                _need(entry is not None and entry["version"] == version, "conflict")
            return self._entry(o.get("kind", "string"), o["value"], o, now), None, True
        if kind == "compare_and_set":
            _need((entry["version"] if entry else 0) == o["expected_version"], "conflict")
            return self._entry("string", o["value"], o, now), None, True
        family, _, action = kind.rpartition("_")
        family = {"": "counter", "sorted_set": "sorted_set"}.get(family, family) if kind != "increment" else "counter"
        _need(family in self.EMPTY, "unknown_operation")
        _need(entry is None or entry["kind"] == family, "wrong_type")
        value = self.EMPTY[family]() if entry is None else json.loads(json.dumps(entry["value"]))
        result = None
        if kind == "increment":
            value += o.get("delta", 1)
            _need(-(2**63) <= value < 2**63, "overflow")
            result = value
        elif family == "hash":
            result = value.pop(o["field"], None)
            if action == "put":
                value[o["field"]] = o["value"]
        elif family == "sorted_set":
            _need(action == "remove" or abs(o.get("score", 0.0)) < float("inf"), "invalid_argument")
            result = value.pop(o["member"], None)
            if action == "add":
                value[o["member"]] = float(o["score"])
        elif family == "set":
            result = o["member"] in value
            value = sorted((set(value) | {o["member"]}) if action == "add" else (set(value) - {o["member"]}))
        elif action == "push":
            value.insert(0 if o.get("side") == "front" else len(value), o["value"])
            result = len(value)
        else:
            result = value.pop(0 if o.get("side") == "front" else -1) if value else None
        base = entry or self._entry(family, value, o, now)
        return {**base, "kind": family, "value": value}, result, True

    def _entry(self, kind: str, value, o: dict, now: int) -> dict:
        return {"kind": kind, "value": value, "version": 0, "expires": self._deadline(o, now), "count": 0, "last": 0, "class": o.get("class", "memory")}

    def _deadline(self, o: dict, now: int) -> int | None:
        ttl = o.get("ttl_ms", self.config.default_ttl_ms)
        _need(ttl is None or ttl > 0, "invalid_argument")
        return None if ttl is None else now + ttl

    def do_multiplex(self, c: dict) -> dict:
        """Independent transactions, each with an ``id``; every one has its own outcome."""
        parts = c["mutations"]
        names = [p.get("id") for p in parts]
        _need(1 <= len(parts) <= 128 and len(set(names)) == len(names) and None not in names, "invalid_argument")
        return {"outcomes": [{"id": p["id"], **self.apply({"op": "transact", "now_ms": c["now_ms"], "operations": p["operations"]})} for p in parts]}

    def do_sweep(self, c: dict) -> dict:
        over = heapq.nsmallest(min(c.get("max") or 1_000, 1_000), [(e["expires"], k) for k, e in self.entries.items() if e["expires"] is not None and e["expires"] <= c["now_ms"]])
        if over:
            self.revision += 1
            for _, key in over:
                self._write(key, None, "expire")
            self._trim()
        return {"revision": self.revision, "removed": [k for _, k in over]}

    def at(self, revision: int) -> dict[str, dict]:
        """The entries at an earlier revision that the history reaches."""
        floor = self.changes[0]["revision"] - 1 if self.changes else self.revision
        _need(floor <= revision <= self.revision, "history_expired")
        out = dict(self.entries)
        for x in reversed(self.changes):
            if x["revision"] <= revision:
                break
            if x["before"] is None:
                out.pop(x["key"], None)
            else:
                out[x["key"]] = x["before"]
        return out

    def do_restore(self, c: dict) -> dict:
        past = {k: e for k, e in self.at(c["revision"]).items() if e["expires"] is None or e["expires"] > c["now_ms"]}
        self.revision += 1
        for key in sorted(set(self.entries) | set(past)):
            self._write(key, {**past[key], "version": self.revision} if key in past else None, "restore")
        self._trim()
        return {"revision": self.revision, "entries": len(past)}


class LockFold(Fold):
    """Exclusive locks with fencing tokens: acquire, renew, release."""

    def __init__(self, max_locks: int = 1_024):
        self.config = max_locks
        self.locks: dict[str, dict] = {}
        self.terms: dict[str, int] = {}
        self.index = 0

    def apply(self, command: dict) -> dict:
        self.index += 1
        now = command["now_ms"]
        self.locks = {k: v for k, v in self.locks.items() if v["deadline"] > now}
        owners = {v["owner"] for v in self.locks.values()}
        self.terms = {k: v for k, v in self.terms.items() if k in owners}
        return super().apply(command)

    def do_acquire(self, c: dict) -> dict:
        _need(c["owner_term"] >= self.terms.get(c["owner"], 0), "fenced")
        _need(c["lock"] not in self.locks, "conflict")
        _need(len(self.locks) < self.config, "capacity")
        self.terms[c["owner"]] = c["owner_term"]
        self.locks[c["lock"]] = lock = {"owner": c["owner"], "term": c["owner_term"], "fence": self.index, "generation": 1, "deadline": c["now_ms"] + c["lease_ms"]}
        return {"fencing_token": lock["fence"], "token": self._token(c["lock"], lock)}

    @staticmethod
    def _token(name: str, lock: dict) -> str:
        return f"{name}.{lock['fence']}.{lock['generation']}"

    def _held(self, c: dict) -> dict:
        lock = self.locks.get(c["lock"])
        _need(lock is not None and lock["owner"] == c["owner"] and lock["term"] == c["owner_term"] and self._token(c["lock"], lock) == c["token"], "fenced")
        return lock

    def do_renew(self, c: dict) -> dict:
        lock = self._held(c)
        deadline = c["now_ms"] + c["lease_ms"]
        _need(deadline > lock["deadline"], "conflict")
        lock.update(deadline=deadline, generation=lock["generation"] + 1)
        return {"fencing_token": lock["fence"], "token": self._token(c["lock"], lock)}

    def do_release(self, c: dict) -> dict:
        self._held(c)
        del self.locks[c["lock"]]
        return {}


class RegistryFold(Fold):
    """Desired resources: apply and delete, idempotent by token and guarded by generation; generations never repeat."""

    def __init__(self):
        self.resources: dict[str, dict] = {}
        self.generations: dict[str, int] = {}
        self.tokens: dict[str, list] = {}

    def apply(self, command: dict) -> dict:
        body = {k: v for k, v in command.items() if k not in ("now_ms", "seq")}
        mark = hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()
        token = command.get("token")
        if token in self.tokens:
            known, answer = self.tokens[token]
            return {**answer, "replayed": True} if known == mark else {"ok": False, "error": "token_reused"}
        answer = super().apply(command)
        if token is not None and answer["ok"]:
            self.tokens[token] = [mark, answer]
        return answer

    def _expected(self, c: dict) -> int:
        actual = self.resources.get(c["name"], {}).get("generation", 0)
        _need(c.get("expected_generation") in (None, actual), "conflict")
        return actual

    def do_apply(self, c: dict) -> dict:
        actual = self._expected(c)
        current = self.resources.get(c["name"])
        if current is not None and current["spec"] == c["spec"]:
            return {"generation": actual, "changed": False}
        generation = self.generations.get(c["name"], 0) + 1
        self.generations[c["name"]] = generation
        self.resources[c["name"]] = {"spec": c["spec"], "generation": generation}
        return {"generation": generation, "changed": True}

    def do_delete(self, c: dict) -> dict:
        self._expected(c)
        _need(c["name"] in self.resources, "not_found")
        del self.resources[c["name"]]
        return {}


class ForwardFold(Fold):
    """An outbox of dead letters for another queue: note, bind, complete; each step may be repeated."""

    def __init__(self):
        self.forwards: dict[str, dict] = {}

    def do_note(self, c: dict) -> dict:
        self.forwards.setdefault(c["id"], {"status": "pending", "destination": None})
        return {"status": self.forwards[c["id"]]["status"]}

    def do_bind(self, c: dict) -> dict:
        f = self.forwards.get(c["id"])
        _need(f is not None, "not_found")
        _need(f["destination"] in (None, c["destination"]), "conflict")
        if f["status"] == "pending":
            f.update(status="bound", destination=c["destination"])
        return {"status": f["status"]}

    def do_complete(self, c: dict) -> dict:
        f = self.forwards.get(c["id"])
        _need(f is not None, "not_found")
        _need(f["status"] != "pending" and f["destination"] == c["destination"], "conflict")
        f["status"] = "completed"
        return {"status": "completed"}


class SubscriptionFold(Fold):
    """The subscriptions of a bus: upsert and remove; every change of the routes has a version."""

    MAX = 1_024

    def __init__(self):
        self.subscriptions: dict[str, dict] = {}
        self.version = 0
        self.history: list[list] = []

    def do_upsert(self, c: dict) -> dict:
        _need(c["name"] in self.subscriptions or len(self.subscriptions) < self.MAX, "capacity")
        self.subscriptions[c["name"]] = c["spec"]
        return self._changed(c)

    def do_remove(self, c: dict) -> dict:
        if self.subscriptions.pop(c["name"], None) is None:
            return {"version": self.version, "removed": False}
        return {**self._changed(c), "removed": True}

    def _changed(self, c: dict) -> dict:
        self.version += 1
        self.history.append([c["now_ms"], self.version])
        return {"version": self.version}


class CaptureFold(Fold):
    """Scheduled captures of a partition: configure and maintain.

    A capture takes what lies between the cursor and the end, or the first
    record of a pending transaction; what retention has taken before is
    reported as skipped.  A late capture moves the next one beyond now.
    """

    MAX = 32

    def __init__(self):
        self.schedules: dict[str, dict] = {}
        self.captures: dict[str, list] = {}

    def do_configure(self, c: dict) -> dict:
        _need(1_000 <= c["interval_ms"] <= 31 * 86_400_000, "invalid_argument")
        self.schedules[c["id"]] = {"interval": c["interval_ms"], "next_offset": c.get("first_offset") or 0, "next_at": c["now_ms"] + c["interval_ms"]}
        return {"next_at_ms": self.schedules[c["id"]]["next_at"]}

    def due(self, now_ms: int) -> list[str]:
        """Schedules that are due, by deadline and name."""
        return [i for _, i in sorted((s["next_at"], i) for i, s in self.schedules.items() if s["next_at"] <= now_ms)]

    def do_maintain(self, c: dict) -> dict:
        s = self.schedules.get(c["id"])
        _need(s is not None, "not_found")
        _need(c["now_ms"] >= s["next_at"], "not_due")
        first = max(s["next_offset"], c["base_offset"])
        end = min(c["end_offset"], c["pending_offset"]) if c.get("pending_offset") is not None else c["end_offset"]
        name = f"auto-{c['id']}-{s['next_at']:020d}"
        if len(self.captures) >= self.MAX:
            own = sorted(k for k in self.captures if k.startswith(f"auto-{c['id']}-"))
            _need(bool(own), "capacity")
            del self.captures[own[0]]
        self.captures[name] = [first, max(end, first)]
        skipped = first - s["next_offset"]
        periods = (c["now_ms"] - s["next_at"]) // s["interval"] + 1
        s.update(next_offset=max(end, first), next_at=s["next_at"] + periods * s["interval"])
        return {"capture": name, "first_offset": first, "end_offset": max(end, first), "skipped": skipped, "next_at_ms": s["next_at"]}


class DigestFold(Fold):
    """A running digest over everything that was applied, to compare copies of a log."""

    def __init__(self):
        self.digest, self.commands = "0" * 64, 0

    def apply(self, command: dict) -> dict:
        body = json.dumps(command, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
        self.digest = hashlib.sha256(bytes.fromhex(self.digest) + len(body).to_bytes(8, "big") + body).hexdigest()
        self.commands += 1
        return {"ok": True, "digest": self.digest}


class KeyValueFold(Fold):
    """A cache whose entries have versions of their own, and events of their own.

    Operations: set (with ``condition``, ``expected_version``), get, delete,
    increment, expire, hash_put, hash_remove, list_push, list_pop, set_add,
    set_remove, sorted_set_add, sorted_set_remove, purge.  Reading touches an
    entry and drops it if it is over; only sets, deletes, expiries and evictions
    are events.  A collection that an operation makes is set first and then
    changed, so its version is 2.  Among equal candidates the least key goes.
    """

    def __init__(self, config: CacheConfig | None = None):
        self.config = config or CacheConfig()
        self.entries: dict[str, dict] = {}
        self.sequence = 0
        self.events: list[dict] = []

    def _event(self, key: str, kind: str, now: int) -> None:
        self.events.append({"sequence": len(self.events) + 1, "key": key, "kind": kind, "at_ms": now})

    def _fresh(self, key: str, now: int) -> dict | None:
        e = self.entries.get(key)
        if e is not None and e["expires"] is not None and e["expires"] <= now:
            del self.entries[key]
            self._event(key, "expire", now)
            return None
        return e

    def _evict(self, now: int) -> None:
        policy = self.config.policy
        _need(policy != "no_eviction", "capacity")
        kind = policy.removeprefix("all_keys_").removeprefix("volatile_")
        rank = {"lru": lambda e: (e["seen"],), "lfu": lambda e: (e["count"], e["seen"]), "ttl": lambda e: (e["expires"],), "random": lambda e: (e["order"],)}[kind]
        pool = [(rank(e), k) for k, e in self.entries.items() if policy.startswith("all_keys_") or e["expires"] is not None]
        _need(bool(pool), "capacity")
        victim = min(pool)[1]
        del self.entries[victim]
        self._event(victim, "evict", now)

    def do_set(self, c: dict) -> dict:
        key, now = c.get("key"), c["now_ms"]
        _need(bool(key), "invalid_argument")
        known = self._fresh(key, now)
        _need(c.get("condition") != "absent" or known is None, "conflict")
        _need(c.get("condition") != "present" or known is not None, "not_found")
        version = known["version"] if known else 0
        _need(c.get("expected_version") in (None, version), "conflict")
        if known is None and len(self.entries) >= self.config.max_entries:
            self._evict(now)
        ttl = c.get("ttl_ms", self.config.default_ttl_ms)
        self.sequence += 1
        self.entries[key] = {"kind": c.get("kind", "string"), "value": c["value"], "version": version + 1, "expires": None if ttl is None else now + ttl, "seen": now, "count": 0, "order": self.sequence, "class": c.get("class", "memory")}
        self._event(key, "set", now)
        return {"version": version + 1}

    def do_get(self, c: dict) -> dict:
        e = self._fresh(c["key"], c["now_ms"])
        if e is None:
            return {"found": False}
        e["seen"], e["count"] = c["now_ms"], e["count"] + 1
        return {"found": True, "value": e["value"], "version": e["version"]}

    def do_delete(self, c: dict) -> dict:
        deleted = self.entries.pop(c["key"], None) is not None
        if deleted:
            self._event(c["key"], "delete", c["now_ms"])
        return {"deleted": deleted}

    def do_expire(self, c: dict) -> dict:
        e = self._fresh(c["key"], c["now_ms"])
        _need(e is not None, "not_found")
        e["expires"], e["version"] = c["now_ms"] + c["ttl_ms"], e["version"] + 1
        return {"version": e["version"]}

    def do_increment(self, c: dict) -> dict:
        delta = c.get("delta", 1)
        e = self._fresh(c["key"], c["now_ms"])
        if e is None:
            self.do_set({"key": c["key"], "now_ms": c["now_ms"], "kind": "counter", "value": delta})
            return {"value": delta}
        _need(e["kind"] == "counter", "conflict")
        _need(-(2**63) <= e["value"] + delta < 2**63, "overflow")
        e.update(value=e["value"] + delta, version=e["version"] + 1, seen=c["now_ms"])
        return {"value": e["value"]}

    def _collection(self, c: dict, kind: str) -> dict:
        e = self._fresh(c["key"], c["now_ms"])
        if e is None:
            self.do_set({"key": c["key"], "now_ms": c["now_ms"], "kind": kind, "value": CacheFold.EMPTY[kind]()})
            e = self.entries[c["key"]]
        _need(e["kind"] == kind, "conflict")
        e.update(version=e["version"] + 1, seen=c["now_ms"])
        return e

    def do_hash_put(self, c: dict) -> dict:
        e = self._collection(c, "hash")
        e["value"][c["field"]] = c["value"]
        return {"version": e["version"]}

    def do_hash_remove(self, c: dict) -> dict:
        return {"removed": self._collection(c, "hash")["value"].pop(c["field"], None) is not None}

    def do_list_push(self, c: dict) -> dict:
        e = self._collection(c, "list")
        e["value"].insert(0 if c.get("side") == "front" else len(e["value"]), c["value"])
        return {"length": len(e["value"])}

    def do_list_pop(self, c: dict) -> dict:
        value = self._collection(c, "list")["value"]
        return {"value": value.pop(0 if c.get("side") == "front" else -1) if value else None}

    def do_set_add(self, c: dict) -> dict:
        e = self._collection(c, "set")
        e["value"] = sorted({*e["value"], c["member"]})
        return {"version": e["version"]}

    def do_set_remove(self, c: dict) -> dict:
        e = self._collection(c, "set")
        e["value"] = sorted({*e["value"]} - {c["member"]})
        return {"version": e["version"]}

    def do_sorted_set_add(self, c: dict) -> dict:
        _need(abs(c["score"]) < float("inf"), "invalid_argument")
        e = self._collection(c, "sorted_set")
        e["value"][c["member"]] = float(c["score"])
        return {"version": e["version"]}

    def do_sorted_set_remove(self, c: dict) -> dict:
        return {"removed": self._collection(c, "sorted_set")["value"].pop(c["member"], None) is not None}

    def do_purge(self, c: dict) -> dict:
        over = sorted(k for k, e in self.entries.items() if e["expires"] is not None and e["expires"] <= c["now_ms"])[: c.get("max") or 1_000]
        for key in over:
            self._fresh(key, c["now_ms"])
        return {"purged": over}
