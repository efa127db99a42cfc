"""Where records come from: discovery, conversion and tailing."""
