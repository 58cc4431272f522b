from trellis.streaming.sessions import every_nth, first_per_session, skip_repeats
from trellis.streaming.watch import watch

__all__ = ["every_nth", "first_per_session", "skip_repeats", "watch"]
