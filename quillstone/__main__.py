import sys

from quillstone.cli import main

sys.exit(main())
