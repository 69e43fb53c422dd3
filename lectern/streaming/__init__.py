"""Click and assessment streams: parsing, total routing, sessions, state, sinks. Functions take batch or streaming frames."""
