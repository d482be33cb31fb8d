"""One function per report; each takes signals and returns a lazy DataFrame."""
