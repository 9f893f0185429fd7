"""Writers: transactions and commits, checkpoints and manifests, rendered output."""
