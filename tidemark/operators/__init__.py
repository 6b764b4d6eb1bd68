"""DataFrame operators over changelogs, snapshots, runs, files and manifests."""
