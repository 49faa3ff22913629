"""A process of its own for code that may hang, crash or leak: killed at a deadline, started anew, renewed after a number of calls.

It lives on between the calls of a task, so a model that a plug-in loads is loaded once. The task's own memory and time stay
its own: what runs in the process can take neither.
"""

from __future__ import annotations

import ctypes
import multiprocessing
import resource
import signal
from collections.abc import Callable, Sequence
from multiprocessing.connection import Connection

#: Calls after which a process is started anew, whatever it holds on to.
RENEWED = 500


class Failed(Exception):
    """A call that gave no result; `died` if the process ended by itself, `late` if it was killed at the deadline."""

    def __init__(self, why: str, died: bool = False, late: bool = False):
        super().__init__(why)
        self.died, self.late = died, late


def _serve(asked: Connection, calls: Sequence[Callable[[bytes], str]], most_bytes: int | None) -> None:
    """Answer calls until the other side is gone. Ends with its task, as the system kills it then."""
    ctypes.CDLL(None).prctl(1, signal.SIGKILL)
    signal.signal(signal.SIGINT, signal.SIG_IGN)
    if most_bytes is not None:
        with open("/proc/self/statm") as held:
            now = int(held.read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (now + most_bytes, now + most_bytes))
    while True:
        try:
            which, data = asked.recv()
        except EOFError:
            return
        try:
            text = calls[which](data)
            if not (text is None or isinstance(text, str)):
                raise TypeError(f"a text is asked for, not {type(text).__name__}")
            answer, spent = (text, None), False
        except MemoryError:
            answer, spent = (None, "MemoryError: more than the process may take"), True
        except Exception as why:  # noqa: BLE001  whatever a plug-in raises belongs to its file
            answer, spent = (None, f"{type(why).__name__}: {why}"), False
        asked.send((*answer, spent))


class Worker:
    """Runs calls in one process at a time. To be closed."""

    def __init__(self, calls: Sequence[Callable[[bytes], str]], most_bytes: int | None = None, renewed: int = RENEWED):
        self.calls, self.most_bytes, self.renewed = calls, most_bytes, renewed
        self.process, self.line, self.done, self.started = None, None, 0, 0

    def _start(self) -> None:
        kind = multiprocessing.get_context("fork")
        self.line, other = kind.Pipe()
        self.process = kind.Process(target=_serve, args=(other, self.calls, self.most_bytes), daemon=True)
        self.process.start()
        other.close()
        self.done, self.started = 0, self.started + 1

    def close(self) -> None:
        if self.process is not None:
            self.line.close()
            self.process.kill()
            self.process.join()
            self.process = None

    def run(self, which: int, data: bytes, seconds: float) -> str | None:
        """The result of a call, or Failed. The process is gone after a deadline, a crash or too much memory."""
        if self.process is not None and self.done >= self.renewed:
            self.close()
        if self.process is None:
            self._start()
        self.done += 1
        try:
            self.line.send((which, data))
            if not self.line.poll(seconds):
                self.close()
                raise Failed(f"no text within {seconds:g} seconds", late=True)
            text, error, spent = self.line.recv()
        except (EOFError, OSError):
            self.process.join(5)
            code = self.process.exitcode
            self.close()
            raise Failed(f"the extractor's process ended with code {code}", died=True) from None
        if spent:
            self.close()
        if error is not None:
            raise Failed(error)
        return text
