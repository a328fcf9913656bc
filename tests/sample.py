"""A small module in Go, written for the tests."""

GO_MOD = """module example.org/shop // the shop

go 1.22.3

toolchain go1.23.0

require golang.org/x/text v0.14.0
require (
	example.com/one v1.0.0
	"example.com/two" v2.1.0+incompatible // indirect
)

exclude example.com/one v0.9.0

replace example.com/one v1.0.0 => ../one
replace (
	example.com/two => example.com/fork v2.2.0
)
"""

TYPES = """// Package cart holds what is bought.
package cart

// Item is one thing in a cart
type Item struct {
	// ID tells items apart
	ID, Number int `json:"id"`

	Name  string `json:"name,omitempty"` // as printed
	price float64

	// Embedded
	Base
	*other.Meta
	List[int]
}

type Base struct{ Made int64 }

// Grouped types
type (
	// hidden by the group's text
	state int
	Names = map[string]*Item
	Check func(a, b string) (ok bool, err error)
	List[T any] []T
	grid [3][4]int
)

/*
Keeper keeps items.

	indented

*/
type Keeper interface {
	// Put one
	Put(item *Item, more ...string) (n int, err error)
	Close() error
	Closer
	~int | ~string
}

const (
	A state = iota + 1
	B
	C
	é, Ü = "raw", `x
y`
)

// Lone comment, set apart

var single, pair = split("a(b", ')', "}")

//go:generate something
// Limit is a limit.
var Limit int = 5
"""

FUNCS = """package cart

import (
	"fmt"
	str "strings"
	_ "embed"
	. "math"
)

import "os"

// New makes an item
func New(name string) *Item {
	if name == "{" { return nil } // }
	s := `
}`
	return &Item{Name: name + s}
}

// Price is a method
func (i *Item) Price(rate float64, _ ...func(int) string) (float64, error) { return i.price * rate, nil }

func (Item) Close() error { return nil }

func (l List[T]) Len() int { return len(l) }

func Map[K comparable, V any](in map[K]V, ch <-chan struct{ A int }) (out []V) {
	for range in { out = append(out, *new(V)) }
	return
}

func extern(int, string)
"""

TEST = """package cart

import "testing"

func TestNew(t *testing.T) { t.Parallel() }

func helper() {}
"""

OTHER = """// Code generated by hand. DO NOT EDIT.

package sub

var X = 1
"""

FILES = {"go.mod": GO_MOD, "cart/types.go": TYPES, "cart/funcs.go": FUNCS, "cart/funcs_test.go": TEST, "cart/deep/sub.go": OTHER, "cart/deep/sub_windows.go": "package sub\n", "cart/testdata/no.go": "not go at all", "_old/no.go": "neither"}


def write(folder):
    for name, text in FILES.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return str(folder)
