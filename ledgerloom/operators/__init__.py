"""DataFrame to DataFrame operators over usage events, rollouts and source files."""
