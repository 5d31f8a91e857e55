from .control import audit_writer, control_steps, control_stream, validate_stream  # noqa: F401
from .online import ChainPaths, append_slice, chain_tables, run_chain, start_chain  # noqa: F401
